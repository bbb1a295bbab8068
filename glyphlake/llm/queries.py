"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import bpe, decontaminate, filter_audit, fingerprints, html_extract, jaccard_join, near_dedup, pii, secret_scan, token_counts, toxicity, url_filter, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(token_counts.count_tokens(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), decode=True))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_byte_bpe, op4_fingerprints, op5_html_text, op6_pii, op7_near_dedup, op8_toxicity, op9_decontamination, op10_url_filter, op11_jaccard_join, op12_vector_codes, op13_filter_audit)}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SHINGLES = """list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)"""


def shingle_rows(name: str, key: str) -> str:
    words = f"list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"(SELECT {key}, unnest({SHINGLES}) AS s FROM (SELECT {key}, {words} AS w FROM {name}))"


LEAKS_SQL = f"""WITH i AS {shingle_rows('benchmark', 'item_id')}, n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS {shingle_rows('documents', 'doc_id')},
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common::DOUBLE / n_item AS containment
FROM c JOIN n USING (item_id) WHERE n_common * 100 >= n_item * 75"""

URL_SQL = """WITH r(verdict, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
 ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS x FROM pages),
v AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
 FROM (SELECT DISTINCT host, path FROM v) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM v LEFT JOIN m USING (host, path)"""

#: Documents that reach each other over links, for a least similarity in per cent.
REACHED_SQL = f"""WITH RECURSIVE s AS {shingle_rows('documents', 'doc_id')},
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= %d * (p.n_shingles + q.n_shingles - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id{{}} FROM m LEFT JOIN n USING (doc_id)"""
DUPLICATES_SQL = (REACHED_SQL % 75).format(", doc_id = component_id AS kept")
JOIN_SQL = (REACHED_SQL % 80).format("")



def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every round as two steps: `a` has each part's nearest entry, `b` the entries after it."""
    far = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    assigned = lambda r: f"a{r} AS (SELECT vec_id, label, pos, x, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT vec_id, label, pos, x, e, {far} AS d FROM p JOIN b{r} USING (pos)) GROUP BY ALL)"
    updated = lambda r: f"""m{r} AS (SELECT pos, e, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM a{r}, (SELECT unnest(range(1, len(c) + 1)) AS i FROM (FROM b0 LIMIT 1)) GROUP BY ALL),
b{r + 1} AS (SELECT pos, e, coalesce(y, c) AS c FROM b{r} LEFT JOIN (SELECT pos, e, list(y ORDER BY i) AS y FROM m{r} GROUP BY ALL) USING (pos, e))"""  # noqa: E731
    steps = ", ".join(f"{assigned(r)}, {updated(r)}" for r in range(rounds))
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT vec_id, label, pos, v[pos * (len(v) // {parts}) + 1 : (pos + 1) * (len(v) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS pos)),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
{steps}, {assigned(rounds)},
f AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY ALL),
s AS (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY pos, e, i)) AS h FROM b{rounds}, (SELECT unnest(range(1, len(c) + 1)) AS i FROM (FROM b0 LIMIT 1)))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM f, s"""


AUDIT_SQL = """WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
m AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * list_unique(ws) < 65 * len(ws))::INT + 4 * (100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(x))::INT
 + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f)
 JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
c AS (SELECT part, filter_order, step, bit, n * (mask & (bit | earlier::BIGINT) = 0)::INT AS kept, (mask & bit > 0 AND mask & earlier::BIGINT = 0)::INT AS gone, n * (mask & bit > 0 AND mask & earlier::BIGINT > 0)::INT AS redundant,
 n * (mask = bit)::INT AS alone, n, good, bad FROM h, s),
g AS (SELECT part, filter_order, step, bit, sum(kept)::BIGINT AS kept, sum(n * gone)::BIGINT AS removed, sum(redundant)::BIGINT AS redundant, sum(alone)::BIGINT AS unique_fails, sum(good * gone)::BIGINT AS good_lost,
 sum(bad * gone)::BIGINT AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g"""

ORACLES = {"op7_near_dedup": DUPLICATES_SQL, "op9_decontamination": LEAKS_SQL, "op10_url_filter": URL_SQL, "op11_jaccard_join": JOIN_SQL, "op12_vector_codes": codes_sql(), "op13_filter_audit": AUDIT_SQL}
