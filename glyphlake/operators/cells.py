"""A search index of cells and short codes that gives the same rows as a full search.

Vectors belong to the nearest of some centres, which are k-means centres of a bounded sample; a cell is one Parquet
partition, so cells that aren't needed aren't read. Within its cell a vector is kept as a code of four bits a number, a
scale and the length of what the code leaves out. From these follow a lowest and a highest score for any query: the true one
lies between them. So a search reads codes first, best cells before others; cells whose farthest vector can't reach the
lowest score of the books found so far are left out; and chunks whose highest score can, for any query, are scored in full.

The index is a list of parts that are never rewritten: rows are added as further parts, taken out by marks that hold for
earlier parts, and merged into one part, with new centres, once enough rows came after the last merge. A version is
published as one small table; readers see the last whole one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphlake.functions import vectors
from glyphlake.functions.batches import freeing
from glyphlake.operators.search import QUERY_BYTES, best_per_book, unit

#: Centres, and vectors at most that they are learnt from (those of the least hashes of their keys).
CELLS, SAMPLE = 64, 20_000
#: Rows added since the last merge, as a share of those merged, from which on a merge is due.
MERGE_SHARE = 0.2
#: Bytes of a matrix that a task works on at once.
WORK_BYTES = 4 << 20
#: Share of all rows whose codes are read before cells are ruled out.
FIRST_SHARE = 0.1

CODES = "cell int, book_id {}, chunk_no {}, code binary, scale double, rest double"


def learn_centres(chunks: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centres of the vectors with the `sample` least hashes of (book_id, chunk_no); fewer than `cells` of few vectors."""
    rows = chunks.orderBy(F.xxhash64("book_id", "chunk_no"), "book_id", "chunk_no").limit(sample)
    rows = rows.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features")).cache()
    n = rows.count()
    try:
        if n <= cells:
            return np.array([r["features"].toArray() for r in rows.collect()]).reshape(n, -1)
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(rows)
        return np.array(model.clusterCenters())
    finally:
        rows.unpersist()


def code_rows(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, book_id, chunk_no, code, scale, rest) of chunks (book_id, chunk_no, vector) of the centres' width."""
    width = centres.shape[1]
    rows = chunks.where(vectors.same_width(F.col("vector"), width)).select("book_id", "chunk_no", "vector")
    kinds = [f.dataType.simpleString() for f in rows.schema][:2]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(1) / 2
        for batch in _pieces(batches, width):
            x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            cell = (x @ centres.T - half).argmax(1)
            left = x - centres[cell]
            scale = np.maximum(np.abs(left).max(1), 1e-300) / 7
            code = np.rint(left / scale[:, None]).astype(np.int8)
            rest = np.linalg.norm(left - code * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
            packed = _packed(code)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(scale), pa.array(rest)], names=["cell", "book_id", "chunk_no", "code", "scale", "rest"])

    return rows.mapInArrow(freeing(made), CODES.format(*kinds))


def _packed(code: np.ndarray) -> np.ndarray:
    """Two numbers from -7 to 7 a byte."""
    even = np.zeros((len(code), code.shape[1] + code.shape[1] % 2), np.uint8)
    even[:, : code.shape[1]] = (code + 8).astype(np.uint8)
    return even[:, ::2] << 4 | even[:, 1::2]


def _unpacked(codes: list[bytes], width: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.stack([packed >> 4, packed & 15], 2).reshape(len(codes), -1)[:, :width].astype(np.float64) - 8


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of as many rows as have WORK_BYTES as vectors in double precision."""
    rows = max(1, WORK_BYTES // (8 * width))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _blocks(rows: int, queries: np.ndarray) -> Iterator[slice]:
    """Queries in blocks whose scores against so many rows have WORK_BYTES."""
    step = max(1, WORK_BYTES // (8 * rows))
    for start in range(0, len(queries), step):
        yield slice(start, min(start + step, len(queries)))


def bounds(batch: pa.RecordBatch, centres: np.ndarray, queries: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The lowest and highest scores of a batch of codes for unit queries, rows by queries, a block of queries at a time."""
    cell, scale, rest = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "scale", "rest"))
    codes = _unpacked(batch.column(batch.schema.get_field_index("code")).to_pylist(), centres.shape[1])
    for at in _blocks(batch.num_rows, queries):
        q = queries[at]
        middle = (centres @ q.T)[cell] + (codes @ q.T) * scale[:, None]
        slack = rest[:, None] * np.linalg.norm(q, axis=1)[None] + 1e-9
        yield at, middle - slack, middle + slack


def _raised(floor: np.ndarray, best: np.ndarray, limit: int) -> np.ndarray:
    """The floor of a block of queries, given what books (rows) reach at least: `limit` of them reach the `limit`-th best."""
    return floor if len(best) < limit else np.fmax(floor, -np.partition(-best, limit - 1, axis=0)[limit - 1])


def lowest_scores(codes: DataFrame, centres: np.ndarray, queries: np.ndarray, limit: int, floor: np.ndarray | None = None) -> np.ndarray:
    """For each query the score that its best `limit` books reach at least, by these codes; -inf where there are fewer.

    `floor` is what is known of it already. A task hands on only what reaches the floor it has found itself."""
    known = np.full(len(queries), -np.inf) if floor is None else floor
    limit = max(1, limit)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = known.copy()
        for batch in _pieces(batches, centres.shape[1]):
            books, run = np.unique(batch.column(batch.schema.get_field_index("book_id")).to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(run, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(run[order]) > 0))
            for at, low, _ in bounds(batch, centres, queries):
                best = np.fmax.reduceat(low[order], first, axis=0)
                least[at] = _raised(least[at], np.where(np.isnan(best), -np.inf, best), limit)
                b, q = np.nonzero(best >= least[at][None])
                yield pa.RecordBatch.from_arrays([pa.array((q + at.start).astype(np.int32)), pa.array(books[b]), pa.array(best[b, q])], names=["q", "book_id", "low"])

    kind = codes.schema["book_id"].dataType.simpleString()
    found = codes.mapInArrow(freeing(made), f"q int, book_id {kind}, low double").groupBy("q", "book_id").agg(F.max("low").alias("low"))
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("low"), "book_id"))).where(F.col("r") == limit)
    out = known.copy()
    for r in ranked.select("q", "low").toLocalIterator():  # one row a query
        out[r["q"]] = max(out[r["q"]], r["low"])
    return out


def candidates(codes: DataFrame, centres: np.ndarray, queries: np.ndarray, least: np.ndarray) -> DataFrame:
    """(book_id, chunk_no) of the chunks whose highest score reaches `least` for any query."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, centres.shape[1]):
            left, kept = batch, []
            for own in list(_blocks(batch.num_rows, queries)):  # what one block of queries wants, others need not look at
                if left.num_rows:
                    hit = np.zeros(left.num_rows, bool)
                    for at, _, high in bounds(left, centres, queries[own]):
                        hit |= (high >= least[own][at][None]).any(1)
                    kept.append(left.filter(pa.array(hit)))
                    left = left.filter(pa.array(~hit))
            for part in kept:
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("book_id", "chunk_no")], names=["book_id", "chunk_no"])

    kinds = [codes.schema[c].dataType.simpleString() for c in ("book_id", "chunk_no")]
    return codes.mapInArrow(freeing(made), f"book_id {kinds[0]}, chunk_no {kinds[1]}")


def best_chunks(chunks: DataFrame, queries: np.ndarray, least: np.ndarray, limit: int) -> DataFrame:
    """(q, book_id, chunk_no): of each query's best `limit` books the best chunk and those that rounding could put before it.

    Vectors are scored in the tasks, all queries against a piece of the rows; of equal vectors of a book only the first chunk
    counts. A task hands on only the best chunks of books that reach `least` and the floor it has found itself."""
    width, limit = queries.shape[1], max(1, limit)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = least.copy()
        for batch in _pieces(batches, width):
            v = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) + 0.0
            fine = np.isfinite(v).all(1)
            if not fine.any():
                continue
            v, batch = v[fine], batch.filter(pa.array(fine))
            run, number = (np.unique(batch.column(i).to_numpy(zero_copy_only=False), return_inverse=True)[1] for i in (0, 1))
            same = np.unique(np.ascontiguousarray(v).view(f"V{8 * width}").ravel(), return_inverse=True)[1]
            order = np.lexsort((number, same, run))
            order = order[np.append(True, (np.diff(run[order]) > 0) | (np.diff(same[order]) != 0))]
            v, run = v[order], run[order]
            first = np.flatnonzero(np.append(True, np.diff(run) > 0))
            tol = 1e-9 * (1 + np.linalg.norm(v, axis=1))[:, None]
            for at in _blocks(len(v), queries):
                scores = v @ queries[at].T
                best = np.maximum.reduceat(scores - tol, first, axis=0)
                floor[at] = _raised(floor[at], best, limit)
                i, q = np.nonzero(scores + tol >= np.maximum(best, floor[at][None])[run])
                taken = pa.array(order[i])
                yield pa.RecordBatch.from_arrays([pa.array((q + at.start).astype(np.int32)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(scores[i, q] - tol[i, 0]), pa.array(scores[i, q] + tol[i, 0])], names=["q", "book_id", "chunk_no", "low", "high"])

    kinds = [chunks.schema[c].dataType.simpleString() for c in ("book_id", "chunk_no")]
    spark = chunks.sparkSession
    dealt = chunks.select("book_id", "chunk_no", "vector").repartition(max(spark.sparkContext.defaultParallelism * 4, 1))  # few bytes, much work
    found = dealt.mapInArrow(freeing(made), f"q int, book_id {kinds[0]}, chunk_no {kinds[1]}, low double, high double").repartition("q")
    own = found.withColumn("n", F.row_number().over(W.partitionBy("q", "book_id").orderBy(F.desc("low"), "chunk_no"))).withColumn("top", F.max("low").over(W.partitionBy("q", "book_id")))
    books = own.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.col("n") == 1), F.desc("low"), "book_id")))
    cut = books.withColumn("cut", F.max(F.when((F.col("n") == 1) & (F.col("r") == limit), F.col("low"))).over(W.partitionBy("q")))
    return cut.where(F.col("high") >= F.greatest("top", "cut")).select("q", "book_id", "chunk_no")  # greatest leaves nulls out


class CellIndex:
    """An index over chunks (book_id, chunk_no, vector) under a path, for one width of vectors."""

    def __init__(self, spark: SparkSession, path: str, cells: int = CELLS, sample: int = SAMPLE):
        self.spark, self.path, self.cells, self.sample = spark, path.rstrip("/"), cells, sample

    # versions: (seq, kind, folder, rows), kinds part, marks and centres

    def _versions(self):
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        system = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(files)] if system.exists(files) else []
        done = [n for n in names if n.startswith("v-") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def entries(self) -> list[tuple]:
        """What the last version is made of, in order."""
        versions = self._versions()
        if not versions:
            return []
        rows = self.spark.read.schema("seq long, kind string, folder string, n long").parquet(f"{self.path}/versions/v-{versions[-1]}")
        return sorted(tuple(r) for r in rows.collect())

    def _publish(self, entries: list[tuple]) -> None:
        following = (self._versions() or [0])[-1] + 1
        self.spark.createDataFrame(entries, "seq long, kind string, folder string, n long").coalesce(1).write.parquet(f"{self.path}/versions/v-{following}")

    def _write(self, df: DataFrame, by: str | None = None) -> tuple[str, int]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        out = df.repartition(by) if by else df
        (out.write.partitionBy(by) if by else out.write).parquet(folder)
        return folder, self.spark.read.schema(df.schema).parquet(folder).count()

    def build(self, chunks: DataFrame) -> None:
        """A fresh index of all these chunks that have the width most have: one part and new centres."""
        width = chunks.where(F.size("vector") > 0).groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
        if width is None:
            raise ValueError("no vectors to learn centres from")
        centres = learn_centres(chunks.where(vectors.same_width(F.col("vector"), width["width"])), self.cells, self.sample)
        folder, n = self._write(code_rows(chunks, centres), "cell")
        rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        held, _ = self._write(self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1))
        seq = max([e[0] for e in self.entries()], default=0) + 1
        kinds = ",".join(chunks.schema[c].dataType.simpleString() for c in ("book_id", "chunk_no"))
        self._publish([(seq, "centres", held, len(centres)), (seq, "part", folder, n), (seq, f"kinds {kinds}", "", 0)])

    def add(self, chunks: DataFrame) -> bool:
        """A further part with these chunks; whether a merge is due since."""
        entries = self.entries()
        folder, n = self._write(code_rows(chunks, self.centres(entries)), "cell")
        if n:
            self._publish([*entries, (max(e[0] for e in entries) + 1, "part", folder, n)])
        sizes = [e[3] for e in self.entries() if e[1] == "part"]
        return sum(sizes[1:]) > MERGE_SHARE * sizes[0]

    def drop(self, keys: DataFrame) -> None:
        """Marks (book_id[, chunk_no]) as gone from all parts so far; later parts may have them again."""
        entries = self.entries()
        kind = "marks" if "chunk_no" in keys.columns else "books"
        folder, n = self._write(keys.select("book_id", *(["chunk_no"] if kind == "marks" else [])).distinct())
        if n:
            self._publish([*entries, (max(e[0] for e in entries) + 1, kind, folder, n)])

    def merge(self, chunks: DataFrame) -> None:
        """One part again, of what the index has of these chunks, with centres learnt anew. Older parts stay for readers of
        older versions."""
        self.build(chunks.join(self.rows().select("book_id", "chunk_no"), ["book_id", "chunk_no"], "left_semi"))

    def centres(self, entries: list[tuple] | None = None) -> np.ndarray:
        folder = next(e[2] for e in entries or self.entries() if e[1] == "centres")
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(folder).orderBy("cell").collect()
        return np.array([r["centre"] for r in rows])

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The codes of the live rows of these cells, or of all: parts without what later marks name."""
        entries, found = self.entries(), None
        kinds = next(e[1] for e in entries if e[1].startswith("kinds "))[6:].split(",")
        schema = T._parse_datatype_string(CODES.format(*kinds))
        for seq, kind, folder, n in entries:
            if kind != "part" or not n:
                continue
            part = self.spark.read.schema(schema).parquet(folder)
            if cells is not None:
                part = part.where(F.col("cell").isin(cells))
            for later, mark, gone, _ in entries:
                if later > seq and mark in ("marks", "books"):
                    keys = ["book_id"] + (["chunk_no"] if mark == "marks" else [])
                    part = part.join(self.spark.read.parquet(gone), keys, "left_anti")
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], schema) if found is None else found.select(*schema.names)

    def cell_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each cell how many rows it has and how far from its centre they reach at most."""
        far = lambda width: F.col("scale") * 7 * float(np.sqrt(width)) + F.col("rest")
        centres = self.centres()
        n, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for r in self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.max(far(centres.shape[1])).alias("r")).collect():
            n[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
        return n, radius

    def search_many(self, chunks: DataFrame, queries: DataFrame, limit: int = 20, min_score: float = 0.0, query_bytes: int = QUERY_BYTES, probes: int | None = None) -> DataFrame:
        """(query_id, book_id, chunk_no, score) as `search.search_many` gives them over the indexed chunks, row for row.

        queries: (query_id, vector); they go to the workers in blocks of at most `query_bytes`. With `probes` only so many
        nearest cells of each query are looked at, and what lies in others is missed. Queries of another width give no row."""
        centres, found, held = self.centres(), None, []
        sizes = self.cell_sizes()
        most = max(1, query_bytes // (8 * centres.shape[1]))
        for r in queries.select("query_id", "vector").where(vectors.same_width(F.col("vector"), centres.shape[1])).toLocalIterator():
            held.append((r["query_id"], unit(r["vector"])))
            if len(held) >= most:
                part = self._found(chunks, held, centres, sizes, limit, probes)
                found, held = part if found is None else found.unionByName(part), []
        if held or found is None:
            part = self._found(chunks, held, centres, sizes, limit, probes)
            found = part if found is None else found.unionByName(part)
        own = queries.select("query_id", F.col("vector").alias("q"))
        pairs = chunks.select("book_id", "chunk_no", "vector").join(found, ["book_id", "chunk_no"]).join(own, "query_id")
        length = F.sqrt(vectors.dot(F.col("q"), F.col("q")))
        q = F.when(length > 0, F.transform("q", lambda x: x.cast("double") / length)).otherwise(F.transform("q", lambda x: x.cast("double")))
        scores = pairs.select("query_id", "book_id", "chunk_no", vectors.dot(F.col("vector"), q).alias("score"))
        best = best_per_book(scores, ("query_id",)).where(F.col("score") >= min_score)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("book_id")))
        return best.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")

    def _found(self, chunks: DataFrame, held: list, centres: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], limit: int, probes: int | None) -> DataFrame:
        """(query_id, book_id, chunk_no) of what comes first for a block of queries, by matrix products, and what could."""
        matrix = np.array([q for _, q in held]).reshape(len(held), centres.shape[1])
        n, radius = sizes
        near = matrix @ centres.T + radius[None] * np.linalg.norm(matrix, axis=1)[:, None] + 1e-9
        filled = np.flatnonzero(n)
        if probes is not None:
            closest = np.argsort(-(matrix @ centres.T - (centres**2).sum(1) / 2), axis=1)[:, :probes]
            cells = sorted(set(closest.ravel().tolist()) & set(filled.tolist()))
            least = lowest_scores(self.rows(cells), centres, matrix, limit)
        else:
            order = filled[np.argsort(-near[:, filled].max(0, initial=-np.inf), kind="stable")]
            first = order[: int(np.searchsorted(np.cumsum(n[order]), FIRST_SHARE * n.sum())) + 1].tolist()
            least = lowest_scores(self.rows(first), centres, matrix, limit)
            cells = [c for c in order.tolist() if (near[:, c] >= least).any()]
            if set(cells) - set(first):
                least = lowest_scores(self.rows(cells), centres, matrix, limit, least)
        near = chunks.where(vectors.same_width(F.col("vector"), centres.shape[1])).join(candidates(self.rows(cells), centres, matrix, least), ["book_id", "chunk_no"], "left_semi")
        wanted = best_chunks(near, matrix, least, limit)
        kind = "long" if not held or isinstance(held[0][0], int) else "string"
        names = self.spark.createDataFrame([(i, k) for i, (k, _) in enumerate(held)], f"q int, query_id {kind}")
        return wanted.join(F.broadcast(names), "q").drop("q")
