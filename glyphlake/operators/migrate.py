"""Migrations of older stores: each step takes the tables of one version and gives those of the next.

Steps are pure functions of DataFrames and can be run again; what a step wrote is checked against what it was made from
(`CHECKS`) before a store publishes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import text, values, vectors
from glyphlake.settings import PRIORITY_DEFAULT

#: Fixed value: what the key of a book's file info begins with in the oldest stores.
FILE_INFO_PREFIX = "fileinfo:"
#: Keys under which older stores kept failures as JSON, and the kinds these become.
FAILURE_KEYS = {"failed": "index", "attr_failed": "attr"}

Tables = dict[str, DataFrame]


class FinalizeCancelled(Exception):
    """Raised at a stage's boundary or on a report of progress once a caller asks to stop."""


def meta_with_prefix(meta: DataFrame, prefix: str) -> DataFrame:
    return meta.where(F.startswith("key", F.lit(prefix)))


def v1_registries(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Registries in columns instead of texts: whole seconds, file info out of meta, attributes as maps, queue rows once."""
    info = meta_with_prefix(tables["meta"], FILE_INFO_PREFIX).select(F.substring("key", len(FILE_INFO_PREFIX) + 1, 40).try_cast("long").alias("book_id"), values.legacy_file_info(F.col("value")).alias("i"))
    attrs = F.transform_values(F.from_json("json", "map<string,string>"), lambda _, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))
    return {
        "books": tables["books"].select(F.col("id").alias("book_id"), "fmt", F.col("indexed_at").cast("long").alias("indexed_at"), F.coalesce("n_chunks", F.lit(0)).cast("int").alias("n_chunks"), "model"),
        "queue": tables["dirty"].select("book_id").distinct().withColumn("priority", F.lit(PRIORITY_DEFAULT)),
        "file_info": info.where("book_id is not null and i is not null").select("book_id", "i.*"),
        "attrs": tables["attrs_raw"].select("book_id", attrs.alias("values")).where("values is not null"),
        "meta": tables["meta"].where(~F.startswith("key", F.lit(FILE_INFO_PREFIX))),
    }


def v2_by_model(chunks: DataFrame) -> DataFrame:
    """Chunks with a normalised model, which the table is partitioned by, numbered within a book by their old numbers."""
    return chunks.select("book_id", F.col("chunk_no").cast("int").alias("chunk_no"), "text", F.col("chapter_path"), "vector", values.normalize_model(F.col("model")).alias("model"))


def v3_half_precision(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, books to queue): vectors at half precision; a book with any vector that isn't finite is dropped whole."""
    bad = chunks.groupBy("book_id").agg(F.bool_and(vectors.finite(F.col("vector"))).alias("ok")).where("not ok").select("book_id")
    kept = chunks.join(bad, "book_id", "left_anti").withColumn("vector", vectors.half_precision("vector"))
    return kept, bad.withColumn("priority", F.lit(PRIORITY_DEFAULT))


def v4_failures(meta: DataFrame, key: str, kind: str) -> DataFrame:
    rows = meta.where(F.col("key") == key).select(F.explode(values.legacy_failures(F.col("value"))).alias("f"))
    return rows.select("f.book_id", F.lit(kind).alias("kind"), "f.error")


def v5_queue(queue: DataFrame) -> DataFrame:
    return queue.select("book_id").distinct().withColumn("priority", F.lit(PRIORITY_DEFAULT))


def verified(before: DataFrame, after: DataFrame, keys: list[str]) -> bool:
    """Whether both have the same values in these columns, each as often: one shuffle of them alone. With hashes of texts
    and vectors among them this compares whole contents, not a few rows."""
    rows = before.select(*keys, F.lit(1).alias("d")).unionByName(after.select(*keys, F.lit(-1).alias("d")))
    return rows.groupBy(*keys).agg(F.sum("d").alias("d")).where("d <> 0").isEmpty()


def transfer_rest(source: DataFrame, done: DataFrame) -> DataFrame:
    """What a transfer that was broken off still has to write: books that are not complete on the other side."""
    counts = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
    rest = counts(source, "want").join(counts(done, "have"), "book_id", "left").where("have is null or have <> want").select("book_id")
    return source.join(rest, "book_id", "left_semi")


def registries_step(t: Tables) -> Tables:
    return {"chunks": t["chunks"], **v1_registries(t)}


def by_model_step(t: Tables) -> Tables:
    """Vectors kept as bytes become numbers, chapter labels lists, and models normalised names."""
    chunks = t["chunks"]
    kinds = dict(chunks.dtypes)
    if kinds["vector"] == "binary":
        chunks = chunks.withColumn("vector", vectors.from_single_bytes("vector"))
    if kinds["chapter_path"] == "string":
        chunks = chunks.withColumn("chapter_path", text.chapter_path(F.col("chapter_path")))
    return t | {"chunks": v2_by_model(chunks)}


def half_precision_step(t: Tables) -> Tables:
    kept, queued = v3_half_precision(t["chunks"])
    lost = queued.select("book_id")
    return t | {"chunks": kept.withColumn("vector", vectors.half_bytes("vector")), "queue": t["queue"].select("book_id", "priority").union(queued), "books": t["books"].join(lost, "book_id", "left_anti")}


def failures_step(t: Tables) -> Tables:
    rows = None
    for key, kind in FAILURE_KEYS.items():
        part = v4_failures(t["meta"], key, kind)
        rows = part if rows is None else rows.union(part)
    return t | {"failed": rows, "meta": t["meta"].where(~F.col("key").isin(*FAILURE_KEYS))}


def queue_step(t: Tables) -> Tables:
    return {k: v for k, v in t.items() if k != "queue"} | {"queue_index": v5_queue(t["queue"])}


#: The step that leads to each version.
STEPS: dict[int, Callable[[Tables], Tables]] = {1: registries_step, 2: by_model_step, 3: half_precision_step, 4: failures_step, 5: queue_step}


def registries_kept(old: Tables, new: Tables) -> bool:
    books = old["books"].select(F.col("id").alias("book_id"), "fmt", F.coalesce("n_chunks", F.lit(0)).cast("int").alias("n_chunks"))
    rest = old["meta"].where(~F.startswith("key", F.lit(FILE_INFO_PREFIX)))
    return verified(books, new["books"], ["book_id", "fmt", "n_chunks"]) and verified(old["dirty"].select("book_id").distinct(), new["queue"], ["book_id"]) and verified(rest, new["meta"], ["key", "value"])


def content(chunks: DataFrame) -> DataFrame:
    """What a step over chunks must keep, text for text and number for number."""
    numbers = F.col("vector") if dict(chunks.dtypes)["vector"] != "binary" else vectors.from_half_bytes("vector")
    return chunks.select("book_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.xxhash64("text").alias("text"), F.xxhash64(numbers.cast("array<float>")).alias("vector"))


def chunks_kept(old: Tables, new: Tables) -> bool:
    chunks = old["chunks"] if dict(old["chunks"].dtypes)["vector"] != "binary" else old["chunks"].withColumn("vector", vectors.from_single_bytes("vector"))
    return verified(content(chunks), content(new["chunks"]), ["book_id", "chunk_no", "text", "vector"])


def halves_kept(old: Tables, new: Tables) -> bool:
    """Every chunk is there with its text and its numbers at half precision, or its book is queued."""
    wanted = old["chunks"].withColumn("vector", vectors.half_precision("vector")).join(new["queue"].select("book_id").join(new["chunks"].select("book_id").distinct(), "book_id", "left_anti").distinct(), "book_id", "left_anti")
    return verified(content(wanted), content(new["chunks"]), ["book_id", "chunk_no", "text", "vector"])


def failures_kept(old: Tables, new: Tables) -> bool:
    counted = sum(v4_failures(old["meta"], k, kind).count() for k, kind in FAILURE_KEYS.items())
    return new["failed"].count() == counted and verified(old["meta"].where(~F.col("key").isin(*FAILURE_KEYS)), new["meta"], ["key", "value"])


def queue_kept(old: Tables, new: Tables) -> bool:
    return verified(old["queue"].select("book_id").distinct(), new["queue_index"], ["book_id"])


#: Whether a version's tables hold what the version before held; both are read from what was written.
CHECKS: dict[int, Callable[[Tables, Tables], bool]] = {1: registries_kept, 2: chunks_kept, 3: halves_kept, 4: failures_kept, 5: queue_kept}
