"""Keyed tables read as a base with changes on top, so that a change costs what it changes and not the table.

A change is a row of the table with three marks: `_seq`, its place in the order of changes; `_reset`, whether it ends
what stood under its keys before; `_live`, whether a row stands there from then on. Putting a row resets and is live, taking it
away resets and is not, and adding to a row of maxima (a queue's highest priority) is live without a reset.

Changes fold: any number of them under one key make one change that does the same, so runs of them can be merged without the
base. Reading joins the base with the folded changes once, on the keys; the base itself is not shuffled as long as Spark
finds the changes small enough to broadcast. Null keys are keys like others. Under equal keys and places the live row wins, of
several the one whose values come last as JSON. Columns of a table must not bear the names of the marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = {"_seq": "bigint", "_reset": "boolean", "_live": "boolean"}
#: Changes of one level that are merged into one of the next; bytes of changes that are never worth a new base. None are: a table
#: that is no larger than a few changes is written as one folder at once, which is as cheap and keeps reading it plain.
FAN, LEAST = 8, 0


def change_schema(kind: T.StructType) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in kind), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in MARKS.items())])


def _place(seq: int | Column) -> Column:
    return (F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("_seq")


def _marked(rows: DataFrame, seq: int | Column, reset: bool, live: bool) -> DataFrame:
    return rows.select("*", _place(seq), F.lit(reset).alias("_reset"), F.lit(live).alias("_live"))


def puts(rows: DataFrame, seq: int | Column) -> DataFrame:
    """Changes that put these rows in place of any under their keys."""
    return _marked(rows, seq, True, True)


def raises(rows: DataFrame, seq: int | Column) -> DataFrame:
    """Changes that add these rows; where one stands, each value is the higher of both."""
    return _marked(rows, seq, False, True)


def drops(ids: DataFrame, kind: T.StructType, keys: Sequence[str], seq: int | Column) -> DataFrame:
    """Changes that take away what stands under these keys."""
    columns = (F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in kind)
    return ids.select(*columns, _place(seq), F.lit(True).alias("_reset"), F.lit(False).alias("_live"))


def folded(changes: DataFrame, keys: Sequence[str], highest: bool = False) -> DataFrame:
    """One change for each key that does what all of them do, one after the other. With `highest`, values are maxima since the last
    reset, else the last change's. One shuffle on the keys."""
    columns = changes.columns
    rest = [c for c in columns if c not in (*keys, *MARKS)]
    if highest:
        last = F.max(F.when(F.col("_reset"), F.col("_seq"))).over(Window.partitionBy(*keys))
        since = changes.withColumn("_last", last).withColumn("_on", F.col("_last").isNull() | (F.col("_seq") >= F.col("_last")))
        held = F.col("_on") & F.col("_live")
        sums = [*(F.max(F.when(held, F.col(c))).alias(c) for c in rest), F.max("_seq").alias("_seq"), F.max("_reset").alias("_reset"), F.max(held).alias("_live")]
        return since.groupBy(*keys).agg(*sums).select(columns)
    order = F.struct("_seq", "_live", F.to_json(F.struct(*rest)) if rest else F.lit(""))
    one = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_seq", "_live"), order).alias("_c"), F.max("_reset").alias("_reset"))
    return one.select(*keys, "_c.*", "_reset").select(columns)


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join in which null keys are equal."""
    other = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & left[k].eqNullSafe(other[f"_k{i}"])
    return left.join(other, met, how)


def merged(base: DataFrame, changes: DataFrame, keys: Sequence[str], highest: bool = False) -> DataFrame:
    """The table after these changes. Keys are unique in the base."""
    top = folded(changes, keys, highest)
    kept = _on(base, top, keys, "left_anti")
    if highest:  # what stood before counts where nothing reset it
        below = raises(_on(base, top, keys, "left_semi"), -1)
        top = folded(below.unionByName(top), keys, True)
    return kept.unionByName(top.where("_live").select(base.columns))


def clustered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ranges of their keys, sorted: a file's least and greatest keys rule out most files when one key is asked for."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def run_due(levels: Sequence[int], fan: int = FAN) -> int:
    """How many of the last changes are to be merged into one: a run of one level, once it has `fan` of them; else 0."""
    if not levels:
        return 0
    run = next((n for n, x in enumerate(reversed(levels)) if x != levels[-1]), len(levels))
    return run if run >= fan else 0


def base_due(base: int, changes: int, least: int = LEAST) -> bool:
    """Whether changes of so many bytes are worth writing a base of so many anew: only once they are half as large, so that a row is
    written a bounded number of times on average however large the table is."""
    return changes > max(least, base // 2)
