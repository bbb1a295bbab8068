"""Registries, queues, failures and the comparison of a library with them: DataFrames in, DataFrames out.

Tables are keyed (see `schemas`); a change is a new DataFrame. Joins are on the key alone, so tables that are bucketed or
partitioned by it join without a shuffle; dimension tables are left for Spark to broadcast by their size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.values import same_file

REGISTRIES = ("books", "queue_index", "attrs", "file_info", "failed", "queue_attrs")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with these rows in place of any under the same keys."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows.select(table.columns))


def remove(table: DataFrame, ids: DataFrame, key: str = "book_id") -> DataFrame:
    return table.join(ids.select(F.col(key)).distinct(), key, "left_anti")


def enqueue(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Each book once, with the highest priority it was given."""
    return queue.unionByName(rows.select("book_id", "priority")).groupBy("book_id").agg(F.max("priority").alias("priority"))


def queue_order(queue: DataFrame) -> DataFrame:
    """Highest priority first, then the newest book."""
    return queue.orderBy(F.desc("priority"), F.desc("book_id"))


def attribute_order(pending: DataFrame, forced: DataFrame) -> DataFrame:
    """Forced books by priority, then pending ones; the newest first in either part; each book once."""
    both = pending.select("book_id").join(forced.select("book_id", F.lit(True).alias("forced"), "priority"), "book_id", "full_outer")
    both = both.groupBy("book_id").agg(F.coalesce(F.max("forced"), F.lit(False)).alias("forced"), F.max("priority").alias("priority"))
    return both.orderBy(F.desc("forced"), F.desc_nulls_last("priority"), F.desc("book_id"))


def named(books: DataFrame, formats: DataFrame, models: DataFrame) -> DataFrame:
    """books (id, fmt_id, model_id, ...) with the names of their format and model, empty where there is none."""
    out = books.join(formats.withColumnRenamed("id", "fmt_id"), "fmt_id", "left").join(models.withColumnRenamed("id", "model_id"), "model_id", "left")
    return out.withColumn("fmt", F.coalesce("fmt", F.lit(""))).withColumn("model", F.coalesce("model", F.lit("")))


def known_books(tables: dict[str, DataFrame]) -> DataFrame:
    """Every id that some registry knows."""
    parts = [tables[t].select("book_id") for t in REGISTRIES if t in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def vanished(library: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return known_books(tables).join(library.select("book_id").distinct(), "book_id", "left_anti")


def reconcile(library: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(book_id, action): 'remove' for books that left the library (from every registry and both queues), 'index' for new
    and changed ones.

    library: (book_id, fmt, size, mtime); a null fmt means there is nothing to read. A new book whose indexing failed
    waits until its file changes. A book without recorded file info has changed if its format has."""
    seen = tables["books"].select("book_id", F.col("fmt").alias("old_fmt"), F.lit(True).alias("indexed"))
    info = tables["file_info"].select("book_id", F.col("fmt").alias("info_fmt"), F.col("size").alias("old_size"), "mtime_s", F.lit(True).alias("recorded"))
    failed = tables["failed"].where("kind = 'index'").select("book_id", F.lit(True).alias("failed")).distinct()
    rows = library.where("fmt is not null").join(seen, "book_id", "left").join(info, "book_id", "left").join(failed, "book_id", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    same = known("recorded") & (F.col("info_fmt") == F.col("fmt")) & same_file(F.col("size"), F.col("mtime"), F.col("old_size"), F.col("mtime_s"))
    moved = F.when(known("recorded"), ~F.coalesce(same, F.lit(False))).otherwise(~F.col("old_fmt").eqNullSafe(F.col("fmt")))
    todo = F.when(known("indexed"), moved).otherwise(~(known("failed") & F.coalesce(same, F.lit(False))))
    return rows.where(todo).select("book_id", F.lit("index").alias("action")).union(vanished(library, tables).select("book_id", F.lit("remove").alias("action")))


def apply_reconcile(actions: DataFrame, tables: dict[str, DataFrame], priority: int = 0) -> dict[str, DataFrame]:
    """The tables after these actions: vanished books leave every table, the others are queued."""
    gone = actions.where("action = 'remove'")
    out = {name: remove(t, gone) if "book_id" in t.columns else t for name, t in tables.items()}
    out["queue_index"] = enqueue(out["queue_index"], actions.where("action = 'index'").withColumn("priority", F.lit(priority)))
    return out


def field_set(values: Column) -> Column:
    return F.array_sort(F.map_keys(values))


def pending_attributes(books: DataFrame, attrs: DataFrame, enabled: Sequence[str], failed: DataFrame | None = None) -> DataFrame:
    """Books with chunks whose stored attributes are not the enabled ones, whatever their order; without those whose
    extraction failed, if given."""
    wanted = F.array_sort(F.array(*[F.lit(x) for x in enabled]).cast("array<string>"))
    rows = books.where("n_chunks > 0").join(attrs.select("book_id", field_set(F.col("values")).alias("have")), "book_id", "left")
    rows = rows.where(~F.col("have").eqNullSafe(wanted)).select("book_id")
    return rows if failed is None else rows.join(failed.where("kind = 'attr'").select("book_id"), "book_id", "left_anti")


def new_and_failed(library: DataFrame, books: DataFrame, failed: DataFrame) -> DataFrame:
    """Books that can be read and are not indexed with chunks, or failed."""
    done = books.where("n_chunks > 0").select("book_id").join(failed.where("kind = 'index'").select("book_id"), "book_id", "left_anti")
    return library.where("fmt is not null").select("book_id").distinct().join(done, "book_id", "left_anti")


def recount(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """books with their chunks counted again; those without any stay, with 0."""
    counts = chunks.groupBy("book_id").agg(F.count("*").cast("int").alias("counted"))
    return books.join(counts, "book_id", "left").withColumn("n_chunks", F.coalesce("counted", F.lit(0))).drop("counted").select(books.columns)


def stale_models(chunk_models: DataFrame, books: DataFrame, current: str | None = None) -> DataFrame:
    """Models with chunks that no book with chunks uses, the current one aside."""
    used = books.where("n_chunks > 0").select("model").distinct()
    out = chunk_models.select("model").distinct().join(used, "model", "left_anti")
    return out if current is None else out.where(F.col("model") != current)


def status(library: DataFrame, books: DataFrame, pending: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: library, books, chunks, with_chunks, attrs_done, attr_failures, index_failures. Four sums of one row each."""
    sums = books.agg(F.count("*").alias("books"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunks"), F.count_if(F.col("n_chunks") > 0).alias("with_chunks"))
    fails = failed.agg(F.count_if(F.col("kind") == "attr").alias("attr_failures"), F.count_if(F.col("kind") == "index").alias("index_failures"))
    one = sums.crossJoin(F.broadcast(fails)).crossJoin(F.broadcast(library.agg(F.count("*").alias("library")))).crossJoin(F.broadcast(pending.agg(F.count("*").alias("pending"))))
    return one.select("library", "books", "chunks", "with_chunks", F.greatest(F.lit(0).cast("long"), F.col("with_chunks") - F.col("pending")).alias("attrs_done"), "attr_failures", "index_failures")


def status_lines(row) -> list[str]:
    """What a status row says, as lines."""
    return [f"Books indexed: {row['books']}/{row['library']}", f"Total chunks: {row['chunks']}", f"Attributes stored: {row['attrs_done']}/{row['with_chunks']} books", *([f"Attribute failures: {row['attr_failures']}"] if row["attr_failures"] else []), *([f"Failed books: {row['index_failures']}"] if row["index_failures"] else [])]


def failures(failed: DataFrame, kind: str | None = None) -> DataFrame:
    return (failed if kind is None else failed.where(F.col("kind") == kind)).orderBy("book_id", "kind")


def results_order(shown: DataFrame, column: str, descending: bool = False, before: str | None = None) -> DataFrame:
    """Rows by a column as a list shows it: texts without regard to case, numbers as numbers; ties keep the order before."""
    key = F.lower(F.col(column)) if dict(shown.dtypes)[column] == "string" else F.col(column)
    return shown.orderBy(F.desc(key) if descending else F.asc(key), *([before] if before else []))


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their place in this order, from 1 on, without one task that sees them all: ranges are sorted each by itself
    and each starts where the ranges before end. The order should leave no ties."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_own", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist(StorageLevel.DISK_ONLY)
    starts, so_far = [], 0
    for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row a range
        starts.append((r["_part"], so_far))
        so_far += r["n"]
    before = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_part", "_own", "_before")
