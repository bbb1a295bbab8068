"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

A test item of n shingles lies in a document to a share t if at least ceil(t n) of its shingles occur there. So of any m of
its shingles a document that holds it holds at least m - (n - ceil(t n)). As those m serve the hashes that fewest items
have, of equals the smallest: the item's MinHash signature. What many items share is left to the others, so a
document that holds such a phrase alone is no candidate for all of them. Items are partitioned by size (powers of two), and the
largest size of a partition gives the length of its signatures. A document of any length is a candidate for each item
of which it has as many signature hashes as it must; this loses nothing, unlike bands over signatures of fixed
length, for which a long document's likeness to a short item is too small. Candidates are confirmed by exact containment of the
shingles as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphlake.llm import shingles
from glyphlake.llm.common import BROADCAST_BYTES, drop_saved, save, small, split_join, unused

THRESHOLD_PERCENT = 75


def signatures(items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(item_id, h, need): the hashes of each item that fewest items have, as many as its size partition asks for, and how many
    of them a document must have."""
    places = items.select("item_id", "ws", F.explode(shingles.starts(F.col("ws"))).alias("i"))
    hashes = save(places.select("item_id", shingles.hashed(F.col("ws"), F.col("i")).alias("h")).distinct(), "leak-hashes")
    common = save(hashes.groupBy("h").agg(F.count("*").alias("items")).where("items > 1"), "leak-common")
    held = split_join(hashes, common.withColumn("rows", F.col("items")), "h", "rows", "left").withColumn("items", F.coalesce("items", F.lit(1)))
    sized = held.withColumn("n", F.count("*").over(W.partitionBy("item_id")))
    most = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    length = F.least("n", most - F.ceil(most * percent / 100) + 1)
    ranked = sized.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy("items", "h"))).where(F.col("rank") <= length)
    found = save(ranked.select("item_id", "h", (length - (F.col("n") - F.ceil(F.col("n") * percent / 100))).cast("long").alias("need")), "leak-signatures")
    drop_saved(hashes, common)
    return found


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = THRESHOLD_PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of every document that holds at least percent % of an item's
    distinct 5-word shingles.

    A text of fewer than five words is one shingle; null and empty texts hold nothing and lie in nothing; very long texts
    are searched whole. Rows of equal id count as one document or item; null ids are compared as equal, and give a
    result with a null id. Equal items each have their rows, and ties of hashes change no result. Empty tables give an empty result; other columns are ignored. Signatures, shingles of items and
    ids of candidates are broadcast up to broadcast_bytes and shuffled beyond."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), shingles.words(F.col(item_text)).alias("ws"))
    spelled = save(items.select("item_id", F.explode(shingles.spelled(F.col("ws"))).alias("s")).distinct(), "leak-items")
    signed = signatures(items, percent)
    ws = docs.select("doc_id", shingles.words(F.col("text")).alias("ws"))
    places = ws.select("doc_id", "ws", F.explode(shingles.starts(F.col("ws"))).alias("i"))
    probes = places.select("doc_id", shingles.hashed(F.col("ws"), F.col("i")).alias("h"))
    hits = probes.join(small(signed, broadcast_bytes), "h").select("doc_id", "item_id", "h", "need").distinct()
    candidates = save(hits.groupBy("doc_id", "item_id", "need").agg(F.count("*").alias("n")).where("n >= need").select("doc_id", "item_id"), "leak-candidates")
    ids = save(candidates.select(F.col("doc_id").alias("id")).distinct(), "leak-suspects")
    suspects = docs.join(small(ids, broadcast_bytes), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    exact = suspects.select("doc_id", shingles.words(F.col("text")).alias("ws")).select("doc_id", F.explode(shingles.spelled(F.col("ws"))).alias("s"))
    sizes = spelled.groupBy("item_id").agg(F.count("*").alias("n_item"))
    wanted = candidates.join(small(spelled.withColumnRenamed("item_id", "item"), broadcast_bytes), F.col("item_id").eqNullSafe(F.col("item"))).select("doc_id", "item_id", "s")
    found = wanted.join(exact.distinct(), wanted["doc_id"].eqNullSafe(exact["doc_id"]) & (wanted["s"] == exact["s"]))
    counted = found.groupBy(wanted["doc_id"], "item_id").agg(F.count("*").alias("n_common"))
    sized = counted.join(sizes.withColumnRenamed("item_id", "item"), F.col("item_id").eqNullSafe(F.col("item")))
    kept = sized.where(F.col("n_common") * 100 >= F.col("n_item") * percent).withColumn("containment", F.col("n_common") / F.col("n_item"))
    result = save(kept.select("doc_id", "item_id", "n_item", "n_common", "containment"), "leaks")
    drop_saved(spelled, signed, candidates, ids)
    return result


def keep_clean(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, all columns, of the documents that hold no item. Rows of one id go or stay together; a null id is equal to
    a null id; an empty table of leaks leaves every row. Columns of `docs` may have any names."""
    leaking = unused("leaking", docs)
    ids = leaks.select(F.col("doc_id").alias(leaking)).distinct()
    return docs.join(small(ids, broadcast_bytes), docs[id_col].eqNullSafe(F.col(leaking)), "left_anti")
