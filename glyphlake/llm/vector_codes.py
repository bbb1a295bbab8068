"""Vectors as one code a part: codebooks of integer centres, one for each part position.

1. Vectors become integers and are cut into parts. Equal parts at one position are one row with a weight, so a vector that
   a third of the table repeats costs as much as one.
2. Weighted Lloyd rounds over these distinct rows: tasks assign them to the nearest entries and hand over sums by entry; the
   driver holds the codebooks, whose size is given by `entries` and the width alone.
3. The distinct rows' codes and errors are joined back to the vectors' parts; parts that many vectors share by broadcast."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import drop_saved, save, split_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are kept within this, so that squared distances and their sums stay within 64 bits.
MOST = 1 << 29
#: Distances worked out at once.
CELLS = 1 << 20


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """(id, label, ints) of the rows whose vectors can be kept."""
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    kept = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0) & whole)
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(numbers, floor).alias("ints"))


def split_parts(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """(row, key) of every part of every vector: the key is the position and the part's integers, joined by commas."""
    key = lambda p: F.concat_ws(",", F.lit(str(p)), F.slice("ints", p * width + 1, width).cast("array<string>"))
    return kept.select("row", F.explode(F.array(*[key(p) for p in range(parts)])).alias("key"))


def unpacked(keys: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and integers of keys."""
    table = np.fromstring(",".join(keys.to_pylist()), np.int64, sep=",").reshape(len(keys), 1 + width)
    return table[:, 0], table[:, 1:]


def nearest(at: np.ndarray, x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry's index, the lower of two as near, and its squared distance."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, CELLS // (books.shape[1] * books.shape[2]))
    for p in range(len(books)):
        rows = np.flatnonzero(at == p)
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            far = ((x[some, None, :] - books[p][None]) ** 2).sum(2)
            code[some] = far.argmin(1)
            error[some] = far[np.arange(len(some)), code[some]]
    return code, error


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the distinct parts (key, weight)."""
    parts, entries, width = books.shape
    sums = [f"s{k}" for k in range(width)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                at, x = unpacked(batch.column(0), width)
                weight = batch.column(1).to_numpy()
                np.add.at(total, at * entries + nearest(at, x, books)[0], np.column_stack([weight, x * weight[:, None]]))
        slots = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), *[pa.array(c) for c in total[slots].T]], names=["slot", "n", *sums])

    found = distinct.select("key", "weight").mapInArrow(summed, f"slot int, n long, {', '.join(f'{s} long' for s in sums)}")
    after = books.copy()
    for slot, n, *s in found.groupBy("slot").agg(F.sum("n"), *[F.sum(c) for c in sums]).collect():  # parts * entries rows at most
        after[slot // entries, slot % entries] = [x // n for x in s]
    return after


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, weight, place, error): place is 256 * position + code."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, x = unpacked(batch.column(0), books.shape[2])
                code, error = nearest(at, x, books)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((at * 256 + code).astype(np.int32)), pa.array(error)], names=["key", "weight", "place", "error"])

    return distinct.select("key", "weight").mapInArrow(made, "key string, weight long, place int, error long")


def spelled(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error) of every vector that can be kept, and the codebooks (part, entry, position).

    A component x is the integer floor(256 * x). Codebooks start as the parts of the vectors of the least `entries` ids (at most 256), or of
    all where there are fewer; ties of distance go to the lower index, entries without parts stay as they are. Rows are
    dropped whose vector is null, holds a null, NaN or infinity, can't be cut into `parts` equal parts, or hasn't the width of the least id's
    vector. Integers beyond 2^29 count as 2^29. Repeated rows are coded each by itself; rows of one id are in order of their integers, a null
    id comes last. Null labels are summed together. Empty tables give an empty result and codebooks without entries. Other
    columns are ignored."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    found = integers(vectors, id_col, vector_col, label_col, parts)
    first = found.orderBy(F.col("id").asc_nulls_last(), F.size("ints"), "ints").select(F.size("ints")).first()
    width = (first[0] if first else parts) // parts
    kept = save(found.where(F.size("ints") == width * parts).withColumn("row", F.monotonically_increasing_id()), "codes-kept")
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    books = np.array([r[0] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    pieces = split_parts(kept, parts, width)
    distinct = save(pieces.groupBy("key").agg(F.count("*").alias("weight")), "codes-distinct")
    for _ in range(rounds if len(seeds) else 0):
        books = lloyd_round(distinct, books)
    codes = save(coded(distinct, books), "codes-coded")
    joined = split_join(pieces, codes, "key", "weight", total=len(seeds) and kept.count() * parts)
    digits = F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda x: F.lower(F.lpad(F.hex(x % 256), 2, "0"))), "")  # one for each part
    by_row = joined.groupBy("row").agg(digits.alias("code"), F.sum("error").alias("error"))
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label")
    rows = save(kept.select("row", "id", label).join(by_row, "row").drop("row"), "codes-rows")
    of_label = save(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight")), "codes-labels")
    result = save(split_join(rows, of_label, "label", "weight").select(F.col("id").alias(id_col), "code", "error", "label_error"), "codes-result")
    drop_saved(kept, distinct, codes, rows, of_label)
    return result, books


def report(result: DataFrame, books: np.ndarray) -> DataFrame:
    """The result with the SHA-256 of all entries, by part, entry and position, as comma-joined decimal numbers."""
    return result.withColumn("codebooks_sha256", F.lit(hashlib.sha256(spelled(books).encode()).hexdigest()))
