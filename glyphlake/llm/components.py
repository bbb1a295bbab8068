"""Connected components by alternating stars: every pass joins neighbours to the smallest id in sight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import drop_saved, save, split_join


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins each id's larger neighbours to the least id among it and its neighbours; a hub's neighbours stay where they
    are (see `split_join`)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("degree"))
    return split_join(both.where("v > u"), least, "u", "degree", total=total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins each id and its smaller neighbours to the least of them. Every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    joined = split_join(edges, least, "u", "degree", total=total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the least id it is linked with, directly or not; ids that stand for
    themselves are left out. A pass sums partial minima before it shuffles; passes go on until one changes nothing, and
    their number is logarithmic."""
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    mark = state(edges)
    while mark[0]:
        starred = save(large_star(edges, mark[0]), "cc-stars")
        after = save(small_star(starred, mark[0]), "cc-edges")
        drop_saved(edges, starred)
        edges, before, mark = after, mark, state(after)
        if mark == before:
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found._scratch_path = edges._scratch_path
    return found
