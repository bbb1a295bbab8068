"""Vector search: the best chunk of each book, books by score; drill-down into one book.

A query scans only ids and vectors; of each book one chunk is kept in each task before anything is shuffled
(row_number under a limit, which Spark pushes below the exchange), the top books are chosen without a full sort, and
texts are fetched for the winners alone. Chunks live in a table partitioned by model, so a model's filter prunes files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphlake.functions import vectors

#: Widths from which scores are worked out by matrix products over Arrow batches instead of JVM expressions.
WIDE = 256
#: Bytes of query vectors that a scan takes along.
QUERY_BYTES = 64 << 20


def unit(query: Sequence[float]) -> list[float]:
    """Of length 1, in double precision; a zero vector stays."""
    v = np.asarray(query, np.float64)
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def scored(chunks: DataFrame, query: Sequence[float], model: str | None = None, exact_cosine: bool = False) -> DataFrame:
    """chunks (book_id, chunk_no, vector[, model]) with a score; vectors of another width are left out.

    A vector is an array of numbers or, as the store keeps it, its half-precision bytes. The score is the product of the
    query, brought to length 1, with the stored vector, or the true cosine."""
    q = unit(query)
    rows = chunks if model is None else chunks.where(F.col("model") == model)
    if isinstance(chunks.schema["vector"].dataType, T.BinaryType):
        return _scored_wide(rows.where(F.octet_length("vector") == 2 * len(q)), q, exact_cosine, halves=True)
    rows = rows.where(vectors.same_width(F.col("vector"), len(q)))
    if len(q) >= WIDE:
        return _scored_wide(rows, q, exact_cosine)
    literal = F.array(*[F.lit(x) for x in q])
    score = vectors.cosine(F.col("vector"), literal) if exact_cosine else vectors.dot(F.col("vector"), literal)
    return rows.withColumn("score", score)


def _matrix(column: pa.Array, width: int, halves: bool) -> np.ndarray:
    """Vectors of one width as rows; half-precision bytes are taken straight from the batch's buffer."""
    if not halves:
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width)
    offsets = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset) if pa.types.is_binary(column.type) else None
    if offsets is None or offsets[-1] - offsets[0] != 2 * width * len(column):
        return np.stack([np.frombuffer(v, "<f2") for v in column.to_pylist()]).astype(np.float32)
    return np.frombuffer(column.buffers()[2], "<f2", width * len(column), int(offsets[0])).reshape(-1, width).astype(np.float32)


def _scored_wide(rows: DataFrame, q: list[float], exact_cosine: bool, halves: bool = False) -> DataFrame:
    query = np.asarray(q, np.float32)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(batch.schema.get_field_index("vector")), len(query), halves)
            s = (m @ query).astype(np.float64)
            if exact_cosine:
                n = np.linalg.norm(m, axis=1)
                s = np.where(n > 0, s / np.where(n > 0, n, 1), 0.0)
            kept = [n for n in batch.schema.names if n != "vector"]  # nothing behind needs vectors: they don't go back
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(s)], names=[*kept, "score"])

    return rows.mapInArrow(made, T.StructType([*(f for f in rows.schema.fields if f.name != "vector"), T.StructField("score", T.DoubleType())]))


def best_per_book(scores: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Each book's best chunk; of equal scores the first model's first chunk."""
    order = [F.desc("score"), *([F.asc("model")] if "model" in scores.columns else []), F.asc("chunk_no")]
    ranked = scores.withColumn("_rank", F.row_number().over(W.partitionBy(*also, "book_id").orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def search(chunks: DataFrame, query: Sequence[float], limit: int = 20, min_score: float = 0.0, model: str | None = None, books: DataFrame | None = None, exact_cosine: bool = False) -> DataFrame:
    """(book_id, chunk_no, score[, fmt]) of the best books, scores falling, then ids rising. As many as `limit` says,
    without a cap of its own (`engine.ask` has the dialog's). A limit of 0 or less, an unknown model or only vectors of another width give no row; min_score is inclusive."""
    keep = [c for c in ("book_id", "chunk_no", "model") if c in chunks.columns]
    best = best_per_book(scored(chunks.select(*keep, "vector"), query, model, exact_cosine).select(*keep, "score")).where(F.col("score") >= min_score)
    top = best.orderBy(F.desc("score"), F.asc("book_id")).limit(max(0, limit))
    if books is None:
        return top
    return top.join(books.select("book_id", "fmt"), "book_id", "left").withColumn("fmt", F.coalesce("fmt", F.lit(""))).orderBy(F.desc("score"), F.asc("book_id"))


def with_texts(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts and paths for the winners only: the few rows are broadcast against the chunk table."""
    keys = [c for c in ("model", "book_id", "chunk_no") if c in top.columns and c in chunks.columns]
    return chunks.drop("vector").join(F.broadcast(top), keys).orderBy(F.desc("score"), F.asc("book_id"))


def search_book(chunks: DataFrame, query: Sequence[float], book_id, min_score: float = 0.0, model: str | None = None, exact_cosine: bool = False) -> DataFrame:
    """All chunks of one book from min_score on, scores falling, then chunk numbers rising; no limit."""
    rows = scored(chunks.where(F.col("book_id") == book_id), query, model, exact_cosine)
    return rows.where(F.col("score") >= min_score).orderBy(F.desc("score"), F.asc("chunk_no"))


def search_many(chunks: DataFrame, queries: DataFrame, limit: int = 20, min_score: float = 0.0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, book_id, chunk_no, score) for every query (query_id, vector): the query set goes to the workers, chunks are
    scanned once, each batch is a matrix product for a block of queries, and a book's best chunk of the batch is chosen
    before anything leaves the task. Query sets of more than query_bytes take a further scan for each so many."""
    found, held, size = None, [], 0
    kind = queries.schema["query_id"].dataType.simpleString()
    for r in queries.select("query_id", "vector").toLocalIterator():
        held.append((r["query_id"], unit(r["vector"])))
        size += 8 * len(held[-1][1])
        if size >= query_bytes:
            part = _scan(chunks, held, kind)
            found, held, size = part if found is None else found.union(part), [], 0
    if held or found is None:
        part = _scan(chunks, held, kind)
        found = part if found is None else found.union(part)
    best = best_per_book(found, ("query_id",)).where(F.col("score") >= min_score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("book_id")))
    return best.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def _scan(chunks: DataFrame, held: list, id_type: str, block: int = 256, rows_at_once: int = 4096) -> DataFrame:
    by_width: dict[int, list] = {}
    for key, q in held:
        by_width.setdefault(len(q), []).append((key, q))
    rows = chunks.select("book_id", "chunk_no", "vector")
    kinds = [f.dataType.simpleString() for f in rows.schema][:2]
    halves = isinstance(rows.schema["vector"].dataType, T.BinaryType)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = {w: ([k for k, _ in qs], np.asarray([q for _, q in qs], np.float64)) for w, qs in by_width.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                count = pa.compute.binary_length if halves else pa.compute.list_value_length
                widths = count(batch.column(2)).fill_null(-1).to_numpy(zero_copy_only=False) // (2 if halves else 1)
                for w, (keys, matrix) in matrices.items():
                    part = batch.filter(pa.array(widths == w))
                    if part.num_rows:
                        v = _matrix(part.column(2), w, halves).astype(np.float64) if halves else np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, w)
                        yield from _best_of_batch(part, v, keys, matrix, block)

    return rows.mapInArrow(made, f"query_id {id_type}, book_id {kinds[0]}, chunk_no {kinds[1]}, score double")


def _best_of_batch(part: pa.RecordBatch, v: np.ndarray, keys: list, matrix: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """The best chunk of each book in the batch for each query; of equal scores the first chunk."""
    books, numbers = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
    order = np.lexsort((numbers, books))
    first = np.flatnonzero(np.append(True, books[order][1:] != books[order][:-1]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    for at in range(0, len(keys), block):
        scores = v[order] @ matrix[at : at + block].T
        top = np.maximum.reduceat(scores, first, axis=0)
        place = np.where(scores == top[run], np.arange(len(order))[:, None], len(order))
        best = order[np.minimum.reduceat(place, first, axis=0)]
        own = keys[at : at + block]
        taken = pa.array(best.T.ravel())
        ids = pa.array(np.repeat(np.arange(len(own)), len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(own).take(ids), part.column(0).take(taken), part.column(1).take(taken), pa.array(top.T.ravel())], names=["query_id", "book_id", "chunk_no", "score"])


def planes(width: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.RandomState(seed).standard_normal((tables * bits, width)).astype(np.float32)


def build_index(chunks: DataFrame, width: int, tables: int = 16, bits: int = 6) -> DataFrame:
    """An approximate index: each vector's signs against random planes, `bits` to a table, one row a table and vector.
    Write it partitioned by table; it is rebuilt by writing it again."""
    normals = planes(width, tables, bits)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width)
            signs = (v @ normals.T > 0).reshape(len(v), tables, bits)
            codes = (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.list_(pa.int32()))], names=["book_id", "chunk_no", "codes"])

    rows = chunks.where(vectors.same_width(F.col("vector"), width)).select("book_id", "chunk_no", "vector")
    kinds = [f.dataType.simpleString() for f in rows.schema][:2]
    coded = rows.mapInArrow(made, f"book_id {kinds[0]}, chunk_no {kinds[1]}, codes array<int>")
    return coded.select("book_id", "chunk_no", F.posexplode("codes").alias("table", "code"))


def search_index(index: DataFrame, chunks: DataFrame, query: Sequence[float], limit: int = 20, min_score: float = 0.0, probes: int = 1, tables: int = 16, bits: int = 6, agree: int = 2) -> DataFrame:
    """As `search`, over the chunks whose code is within `probes` flipped bits of the query's in at least `agree` tables;
    scores are exact."""
    near = index_candidates(index, query, probes, tables, bits, agree)
    return search(chunks.join(near, ["book_id", "chunk_no"], "left_semi"), query, limit, min_score)


def index_candidates(index: DataFrame, query: Sequence[float], probes: int = 1, tables: int = 16, bits: int = 6, agree: int = 2) -> DataFrame:
    """(book_id, chunk_no) of the chunks that `search_index` scores."""
    q = np.asarray(unit(query), np.float32)
    signs = (planes(len(q), tables, bits) @ q).reshape(tables, bits) > 0
    own = (signs * (1 << np.arange(bits))).sum(1).tolist()
    wanted = [(t, code) for t in range(tables) for code in range(1 << bits) if (code ^ own[t]).bit_count() <= probes]
    keys = index.sparkSession.createDataFrame(wanted, "table int, code int")
    return index.join(F.broadcast(keys), ["table", "code"]).groupBy("book_id", "chunk_no").agg(F.count("*").alias("_n")).where(F.col("_n") >= agree).drop("_n")


def delete_chunk(chunks: DataFrame, book_id, chunk_no) -> DataFrame:
    """Without this chunk; the rest keep their numbers."""
    return chunks.where(~((F.col("book_id") == book_id) & (F.col("chunk_no") == chunk_no)))


def clamp_min_score(c: Column | float):
    return min(1.0, max(0.0, c)) if isinstance(c, float | int) else F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
