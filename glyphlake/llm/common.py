"""What the operators of this subpackage share: scratch tables, input columns, byte-balanced batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.batches import freeing as freeing

#: Whitespace that separates words in every operator on word shingles (ASCII only, stated in hex).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode, where there are no other machines, one under
    the warehouse serves if it is unset; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new Parquet table in the shared folder and reads it again: lineage ends there.

    A lost executor loses nothing of it, and each reader takes only the columns it needs. What `drop_saved` hasn't deleted
    goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Deletes tables that `save` made, through Spark's own file system layer."""
    for df in tables:
        files, at = _at(df.sparkSession, df._scratch_path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


#: Bytes of rows that Spark gathers in an Arrow batch for Python, and the setting that says so.
ARROW_BYTES, ARROW_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets Spark's Arrow batches to ARROW_BYTES where the session has no size of its own. A batch is held several times over,
    in the executor and in its worker, in each of its tasks; Spark's own size would take in a whole split."""
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


#: Bytes of text that an operator's Python code works on at once, whatever Arrow batches Spark hands over.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterable[pa.RecordBatch], at: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that column `at` has at most `limit` bytes a slice; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            upto = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, upto - start)
            start = upto


#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def size_of(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table of numbers, texts and binaries: the bytes of its values and 16 for each field."""
    wide = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    found = df.agg(F.count("*"), *wide).first()
    return found[0], found[0] * 16 * len(df.columns) + sum(found[1:])


def wide(df: DataFrame) -> bool:
    """Whether a row can be of any length."""
    return any(f.dataType.typeName() in ("string", "binary", "array") for f in df.schema)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, to be broadcast if it has at most `limit` bytes, which is worked out first; give it saved tables."""
    return F.broadcast(df) if size_of(df)[1] <= limit else df


#: Keys at most that `split_join` broadcasts.
HOT_KEYS = 100_000


def split_join(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined to table, which has each key once and, in column `weight`, how many rows have it.

    Rows of a hot key, which one task would hold together, are joined by broadcast. A key is hot if it has more than one of
    HOT_KEYS equal shares of `total` rows (and more than 64), so there are at most HOT_KEYS of them whatever the data; where
    what rides along is wide, fewer, so that they have at most BROADCAST_BYTES. All others are joined as Spark sees fit. The
    weight is left out of the result. `how` is inner, left_semi or left. Give it saved tables."""
    total = table.agg(F.sum(weight)).first()[0] or 0 if total is None else total
    least = max(64, -(-total // HOT_KEYS))
    while wide(table) and size_of(table.where(F.col(weight) > least).drop(weight))[1] > BROADCAST_BYTES:
        least *= 2
    hot, rest = (table.where(F.col(weight) > least).drop(weight), table.where(F.col(weight) <= least).drop(weight))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    if how == "left":  # a null key is equal to none; rows that have it must not meet in one task either
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in rest.schema if f.name != key]
        apart = cold.where(F.col(key).isNull()).select("*", *more)
        return rows.join(F.broadcast(hot), key).unionByName(cold.where(F.col(key).isNotNull()).join(rest, key, "left")).unionByName(apart)
    return rows.join(F.broadcast(hot), key, how).unionByName(cold.join(rest, key, how))


def unused(name: str, *tables: DataFrame) -> str:
    """A column name, like the one given, that none of these tables has in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, so that other columns never clash; a null text counts as empty."""
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def utf8_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(items: Iterable[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, str]]]:
    """Batches of (key, text) of about `limit` UTF-8 bytes each; a longer text is a batch of its own."""
    batch, size = [], 0
    for key, text in items:
        own = utf8_size(text)
        if batch and size + own > limit:
            yield batch
            batch, size = [], 0
        batch.append((key, text))
        size += own
    if batch:
        yield batch
