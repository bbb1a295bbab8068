"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests and
rule precedence; DataFrame functions only.

A rule has a shape: how many labels its host has, how long its path is. A URL has at most one expression of a shape, and no
two rules are the same expression once the verdict is settled. So with rules of few shapes that can be broadcast, each
shape is one outer equi-join that keeps every row in its place, and the best rule is chosen within the row: nothing is
shuffled. Otherwise distinct hosts and paths are expanded into all suffixes and prefixes as long as any rule's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import BROADCAST_BYTES, size_of
from glyphlake.llm.shingles import UPPER

#: (verdict, host and path) of the rules that the query op10_url_filter applies.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "example.net/de/8"), ("allow", "net/de/"), ("block", "org/es/"))
#: What a URL gets that no rule fits.
DEFAULT = "allow"
PREFIX_HEX = 8
#: Shapes up to which each is a join of its own.
SHAPES = 24


def after_scheme(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end; A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Rules as a DataFrame (verdict, rule), from literals; a table of the same columns serves as well."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]).cast("array<struct<verdict:string,rule:string>>")
    return spark.range(1).select(F.inline(rows))


def shaped(rules: DataFrame, prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """(rule, verdict, host_len, labels, path_len, digest, short) of each rule once; block wins over allow."""
    once = rules.where("rule is not null").groupBy("rule").agg(F.max_by("verdict", F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("verdict"))
    host = F.substring_index("rule", "/", 1)
    sized = once.select("rule", "verdict", F.length(host).alias("host_len"), F.size(F.split(host, r"\.")).alias("labels"), (F.length("rule") - F.length(host)).alias("path_len"), F.sha2("rule", 256).alias("digest"))
    return sized.withColumn("short", F.substring("digest", 1, prefix_hex))


def by_shapes(parts: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], prefix_hex: int) -> DataFrame:
    """parts with `won`, the best of the rules: one broadcast join a shape, no row moves."""
    labels, found = F.size(F.split("host", r"\.")), []
    for k, (n, m) in enumerate(shapes):
        fits = (F.col("host") != "") & (labels >= n) & (F.length("path") >= m)
        parts = parts.withColumn(f"full_{k}", F.when(fits, F.sha2(F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)), 256)))
        own = rules.where((F.col("labels") == n) & (F.col("path_len") == m))
        own = own.select(F.col("short").alias(f"short_{k}"), F.col("digest").alias(f"digest_{k}"), F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict").alias(f"rule_{k}"))
        same = (F.substring(f"full_{k}", 1, prefix_hex) == F.col(f"short_{k}")) & (F.col(f"full_{k}") == F.col(f"digest_{k}"))
        parts = parts.join(F.broadcast(own), same, "left")
        found.append(F.col(f"rule_{k}"))
    best = F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<n:int,host_len:int,rule:string,verdict:string>")
    return parts.withColumn("won", best)


def by_expansion(parts: DataFrame, rules: DataFrame, prefix_hex: int) -> DataFrame:
    """parts with `won`, by all suffixes and prefixes of distinct hosts and paths that are no longer than any rule's."""
    most = rules.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("path_len"), F.lit(0)).alias("path")).first()
    each = parts.where("host <> ''").select("host", "path").distinct()
    suffixes = each.select("host", "path", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(max(1, most["labels"]))))).alias("n"))
    spread = suffixes.select("host", "path", F.expr("substring_index(host, '.', -n)").alias("suffix"), F.explode(F.sequence(F.lit(0), F.least(F.length("path"), F.lit(most["path"])))).alias("m"))
    probes = spread.select("host", "path", F.sha2(F.expr("concat(suffix, substring(path, 1, m))"), 256).alias("full")).withColumn("short", F.substring("full", 1, prefix_hex))
    confirmed = probes.join(rules, "short").where(F.col("full") == F.col("digest"))
    best = confirmed.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict")).alias("won"))
    return parts.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, prefix_hex: int = PREFIX_HEX, shapes: int = SHAPES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A rule fits its host and all subdomains of it if the path starts with the rule's path. The longest rule wins; of
    equally long ones the one with the longer host; of one rule with both verdicts, block. A null URL, or one without
    ://, has an empty host and path, which no rule with a host fits. Repeated rows, ties and null ids keep their rows; empty
    tables of pages give an empty result, of rules the default for all; other columns are ignored. A very long
    URL gives no more expressions than the rules have shapes, or suffixes times prefixes as long as any rule's."""
    keyed = shaped(rules, prefix_hex)
    known = [(r.labels, r.path_len) for r in keyed.select("labels", "path_len").distinct().sort("labels", "path_len").limit(shapes + 1).collect()]
    parts = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    near = len(known) <= shapes and size_of(keyed)[1] <= broadcast_bytes
    judged = by_shapes(parts, keyed, known, prefix_hex) if near else by_expansion(parts, keyed, prefix_hex)
    return judged.select(id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
