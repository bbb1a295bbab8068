"""Queries over the driver's tables, one or more for each operator, and independent DuckDB SQL for those that SQL can express.

The tables stand in for a library: embeddings for chunk vectors (label as book, vec_id as chunk), documents for plain texts,
pages for pages, conversations for ordered chunks, and columns of the star schema for names, formats and files. Arrays
are given as joined texts, scores rounded to six places."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import text, values, vectors
from glyphlake.operators import attributes, cells, keyed, packing, pages, registry, search
from glyphlake.settings import MIN_EXTRACTED_CHARS, max_chunk_chars, text_budget_chars

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("book_id"), F.col("vec_id").alias("chunk_no"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


SCORES = """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT label AS book_id, vec_id AS chunk_no, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / sqrt(list_dot_product(q, q)) AS score FROM embeddings, q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY score DESC, chunk_no) = 1)
"""


@query(SCORES + "SELECT book_id, chunk_no, round(score, 6) AS score FROM b ORDER BY b.score DESC, book_id LIMIT 20")
def search_topk(spark, sf_dir):
    return rounded(search.search(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), 20))


@query(SCORES + "SELECT book_id, chunk_no, round(score, 6) AS score FROM b WHERE b.score >= 0.3 ORDER BY b.score DESC, book_id LIMIT 5")
def search_min_score(spark, sf_dir):
    return rounded(search.search(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), 5, 0.3))


@query(SCORES + "SELECT book_id, chunk_no, round(score, 6) AS score FROM s WHERE book_id = 3 AND s.score >= 0.0")
def search_book(spark, sf_dir):
    return rounded(search.search_book(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), 3).select("book_id", "chunk_no", "score"))


@query(SCORES + "SELECT book_id, chunk_no, round(score, 6) AS score FROM b")
def best_chunk_per_book(spark, sf_dir):
    return rounded(search.best_per_book(search.scored(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir)).drop("vector")))


@query("""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, label AS book_id, vec_id AS chunk_no, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / sqrt(list_dot_product(q, q)) AS score FROM embeddings, q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, book_id ORDER BY score DESC, chunk_no) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS r FROM b)
SELECT query_id, book_id, chunk_no, round(score, 6) AS score FROM t WHERE r <= 5""")
def search_many(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rounded(search.search_many(chunk_vectors(spark, sf_dir), rows, 5))


@query(ORACLES["search_many"])
def search_many_cells(spark, sf_dir):
    """The same rows from an index of cells and codes, built for it in the folder that all machines share."""
    home = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    chunks = chunk_vectors(spark, sf_dir)
    index = cells.CellIndex(spark, f"{home.rstrip('/')}/cells-{uuid.uuid4().hex}")
    index.build(chunks)
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rounded(index.search_many(chunks, rows, 5))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT label AS book_id, vec_id AS chunk_no, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, q""")
def cosine_scores(spark, sf_dir):
    return rounded(search.scored(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), exact_cosine=True).drop("vector"))


@query("SELECT label AS book_id, count(*) FILTER (WHERE NOT (label = 3 AND vec_id % 7 = 0)) AS n_chunks FROM embeddings GROUP BY label")
def delete_chunk_recount(spark, sf_dir):
    chunks = chunk_vectors(spark, sf_dir)
    books = chunks.groupBy("book_id").agg(F.count("*").cast("int").alias("n_chunks"))
    rest = search.delete_chunk(chunks, 3, F.col("chunk_no") - F.col("chunk_no") % 7)
    return registry.recount(books, rest).withColumn("n_chunks", F.col("n_chunks").cast("long"))


@query("SELECT vec_id, len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AS finite FROM embeddings")
def vector_validate(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.finite(F.col("embedding")).alias("finite"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first_x, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 4) AS sum_x FROM v""")
def l2_normalize(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5)).alias("v"))
    unit = scaled.select("vec_id", vectors.normalized(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0].cast("double"), 5).alias("first_x"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 4).alias("sum_x"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::FLOAT AS x FROM embeddings), m AS (SELECT vec_id, x, CASE WHEN x = 0 THEN 1 ELSE pow(2, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END AS unit FROM v),
h AS (SELECT vec_id, x, (round_even(x::DOUBLE / unit, 0) * unit)::FLOAT AS half FROM m)
SELECT vec_id, max(abs(x - half)::DOUBLE / greatest(abs(x)::DOUBLE, 0.001)) AS largest_error FROM h GROUP BY vec_id""")
def f16_roundtrip(spark, sf_dir):
    halves = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.half_precision("embedding").alias("half"))
    return halves.select("vec_id", F.array_max(F.zip_with("embedding", "half", lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.lit(1e-3)))).cast("double").alias("largest_error"))


@query("SELECT label AS book_id, count(*) AS n_rows, greatest(1, ceil(count(*) * 1000000::DOUBLE / (4294967295 // len(any_value(embedding)) // 2))::BIGINT) AS parts FROM embeddings GROUP BY label")
def partition_maths(spark, sf_dir):
    rows = chunk_vectors(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("n_rows"), F.first(F.size("vector")).alias("dim"))
    return rows.select("book_id", "n_rows", vectors.partitions(F.col("n_rows") * 1_000_000, F.col("dim")).alias("parts"))


def _far(name: str) -> str:
    return " OR ".join(f"unicode(c) BETWEEN {a} AND {b}" for a, b in text.SCRIPTS[name])


_CHARS = "list_filter(string_split(coalesce(text, ''), ''), lambda c: {})"


@query("SELECT doc_id, " + ", ".join(f"len({_CHARS.format(_far(t))}) AS {t}" for t in text.TIERS) + ", length(coalesce(text, '')) - (" + " + ".join(f"len({_CHARS.format(_far(t))})" for t in text.TIERS) + ") AS latin FROM documents")
def script_mix(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").select("doc_id", text.script_counts(F.col("text")).alias("c"))
    return counts.select("doc_id", *[F.col(f"c.{t}").cast("long").alias(t) for t in (*text.TIERS, "latin")])


@query("SELECT doc_id, greatest(1, floor(length(text) * 0.2::DOUBLE + 0.5::DOUBLE))::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


#: Characters of every tier, and beside their ranges: (tokens for each in hundredths, text).
SAMPLES = ((70, "\u3000\u30ff\u4e2d\u9fff\uac00\uff21\U00020000"), (60, "\u0600\u06ff\u0750\ufb50\ufefe"), (40, "\u0370\u0436\u052f\u0531\u05d0\u0905\u0e01\u10a0"), (20, "a\u036f\u0700\u1100\u2028\u33ff\ua000\U0001f600"))


@query("SELECT doc_id, greatest(1, floor((length(text) * 20" + "".join(f" + (doc_id % {k + 3}) * {n * len(s)}" for k, (n, s) in enumerate(SAMPLES)) + ") / 100.0::DOUBLE + 0.5::DOUBLE))::BIGINT AS tokens FROM documents")
def token_estimate_scripts(spark, sf_dir):
    """Texts with characters of all scripts behind them, as often as the id says."""
    rows = table(spark, sf_dir, "documents")
    mixed = F.concat("text", *[F.repeat(F.lit(s), (F.col("doc_id") % (k + 3)).cast("int")) for k, (_, s) in enumerate(SAMPLES)])
    return rows.select("doc_id", text.estimate_tokens(mixed).cast("long").alias("tokens"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY i) = 1)
SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY i) AS found FROM f GROUP BY doc_id""")
def distinct_words(spark, sf_dir):
    """The first spelling of each word of a text, in order."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", values.distinct_values(F.split("text", " ")).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.array_join("v", " ").alias("found"))


FILE_ROWS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE cast(o_custkey AS VARCHAR{}) END AS size, CASE WHEN o_orderkey % 7 = 0 THEN 'never' ELSE concat(cast(o_orderkey - 1000 AS VARCHAR{}), '.75') END AS mtime FROM {}"


@query(f"""WITH f AS ({FILE_ROWS.format("", "", "orders")})
SELECT o_orderkey, CASE WHEN ok THEN try_cast(size AS BIGINT) END AS size, CASE WHEN ok THEN trunc(try_cast(mtime AS DOUBLE))::BIGINT END AS mtime_s
FROM (SELECT *, try_cast(size AS BIGINT) IS NOT NULL AND try_cast(mtime AS DOUBLE) IS NOT NULL AS ok FROM f)""")
def file_infos(spark, sf_dir):
    """Sizes and times as whole numbers, none where either is missing."""
    given = spark.sql(FILE_ROWS.format("(20)", "(20)", "{orders}"), orders=table(spark, sf_dir, "orders"))
    return given.select("o_orderkey", values.file_info(F.col("size"), F.col("mtime")).alias("i")).select("o_orderkey", "i.size", "i.mtime_s")


@query("SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS chars, CASE WHEN chars < 1000 THEN 'fail' ELSE 'index' END AS action FROM documents")
def extraction_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("text").alias("p"))
    return packing.guard(rows, "doc_id", "p", MIN_EXTRACTED_CHARS)


@query("SELECT doc_id, len(p) AS n, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS p FROM documents)")
def plain_paragraphs(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    return parts.select("doc_id", F.size("p").cast("long").alias("n"), F.array_max(F.transform("p", F.length)).cast("long").alias("longest"))


@query("SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n FROM documents WHERE n > 0")
def packed_characters(spark, sf_dir):
    """Nothing is lost in packing: the characters of a text's chunks, overlaps and breaks aside."""
    packed = packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 0)
    chunks = packing.chunk_rows(packed, "doc_id")
    return chunks.groupBy("doc_id").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n"))


LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT doc_id, list_transform({LINES}, lambda x: length(x) + 2) AS c FROM documents),
f AS (SELECT doc_id, c, list_reduce(list_transform(list_prepend(0, c), lambda x: {{'n': 0::BIGINT, 'used': 0::BIGINT, 'x': x::BIGINT}}),
 lambda s, e: {{'n': CASE WHEN s.n = 0 OR s.used + e.x > 1000 THEN s.n + 1 ELSE s.n END, 'used': CASE WHEN s.n = 0 OR s.used + e.x > 1000 THEN e.x ELSE s.used + e.x END, 'x': e.x}}) AS r FROM p WHERE len(c) > 0)
SELECT doc_id, r.n AS n_chunks, len(c) - 1 AS last_paragraph FROM f""")
def line_chunks(spark, sf_dir):
    """Chunks of lines as paragraphs, without overlap or token budget: how many, and the last one's last line."""
    split = lambda t: [x for line in t.split("\n") if (x := line.strip())]
    packed = packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 0, split=split)
    return packed.where(F.size("chunks") > 0).select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.element_at("chunks", -1)["para_end"].cast("long").alias("last_paragraph"))


OPENS = "s.n = 0 OR s.used + e.x > 1000"


@query(f"""WITH p AS (SELECT doc_id, list_transform({LINES}, lambda x: length(x) + 2) AS c FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(list_prepend(0, c), lambda x: {{'n': 0::BIGINT, 'used': 0::BIGINT, 'i': 0::BIGINT, 'off': 0::BIGINT, 'first': 0::BIGINT, 'at': 0::BIGINT, 'x': x::BIGINT}}),
 lambda s, e: {{'n': CASE WHEN {OPENS} THEN s.n + 1 ELSE s.n END, 'used': CASE WHEN s.n = 0 THEN e.x WHEN {OPENS} THEN least(150, s.used - 2) + 2 + e.x ELSE s.used + e.x END, 'i': s.i + 1, 'off': s.off + e.x,
  'first': CASE WHEN {OPENS} THEN s.i ELSE s.first END, 'at': CASE WHEN {OPENS} THEN s.off ELSE s.at END, 'x': e.x}}) AS r FROM p WHERE len(c) > 0)
SELECT doc_id, r.n AS n_chunks, r.first AS first_line, r.at AS char_offset FROM f""")
def line_chunks_overlap(spark, sf_dir):
    """Chunks of lines that open with the end of the chunk before: how many, and where the last one's own lines begin."""
    split = lambda t: [x for line in t.split("\n") if (x := line.strip())]
    packed = packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 150, split=split).where(F.size("chunks") > 0)
    last = F.element_at("chunks", -1)
    return packed.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), last["para_start"].cast("long").alias("first_line"), last["char_offset"].cast("long").alias("char_offset"))


@query()
def chunk_pack(spark, sf_dir):
    packed = packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 150, 6502)
    return packing.chunk_rows(packed, "doc_id").select("doc_id", "chunk_no", "text", text.chapter_label(F.col("chapter_path")).alias("path"), "para_start", "para_end", "char_offset")


@query()
def html_units(spark, sf_dir):
    units = pages.page_units(table(spark, sf_dir, "pages"))
    return units.select("page_id", F.posexplode("units").alias("unit_no", "u")).select("page_id", "unit_no", "u.kind", "u.level", "u.text")


@query()
def chapter_paths(spark, sf_dir):
    found = pages.page_paragraphs(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.posexplode("paragraphs").alias("para_no", "p")).select("page_id", "para_no", "p.text", text.chapter_label(F.col("p.path")).alias("path"))


@query()
def page_chunks(spark, sf_dir):
    made = pages.page_paragraphs(table(spark, sf_dir, "pages"))
    return packing.chunk_rows(packing.pack_units(made, "page_id", "paragraphs", 1000, 150, 6502), "page_id").withColumn("chapter_path", text.chapter_label(F.col("chapter_path")))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, greatest(1, floor(length(text) * 0.2::DOUBLE + 0.5::DOUBLE))::BIGINT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
b AS (SELECT conv_id, sum(t) / greatest(1, ceil(sum(t)::DOUBLE / 200))::DOUBLE AS even FROM c GROUP BY conv_id),
g AS (SELECT conv_id, turn, i, t AS used, 0 AS grp FROM c WHERE i = 1 UNION ALL
 SELECT c.conv_id, c.turn, c.i, CASE WHEN g.used >= even OR g.used + t > 200 THEN t ELSE g.used + t END, g.grp + (CASE WHEN g.used >= even OR g.used + t > 200 THEN 1 ELSE 0 END)
 FROM g JOIN c ON c.conv_id = g.conv_id AND c.i = g.i + 1 JOIN b ON b.conv_id = c.conv_id)
SELECT conv_id, turn, grp::BIGINT AS grp FROM g""")
def map_groups(spark, sf_dir):
    """Turns of a conversation in contiguous groups of at most 200 estimated tokens, evenly filled."""
    ordered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    grouped = F.udf(lambda c: [g for g, members in enumerate(packing.map_groups([x["text"] for x in c], tokens=200)) for _ in members], "array<long>", useArrow=True)
    rows = ordered.select("conv_id", F.explode(F.arrays_zip(F.col("c.turn").alias("turn"), grouped("c").alias("grp"))).alias("x"))
    return rows.select("conv_id", "x.turn", "x.grp")


@query("""WITH c AS (SELECT conv_id, turn, text, greatest(1, floor(length(text) * 0.2::DOUBLE + 0.5::DOUBLE))::BIGINT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
w AS (SELECT *, sum(t) OVER (PARTITION BY conv_id) AS total FROM c),
p AS (SELECT * FROM w WHERE total <= 100 OR i % ((total + 99) // 100) = 0),
k AS (SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY i) AS used FROM p)
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS sample FROM k WHERE total <= 100 OR i = 0 OR used <= 100 GROUP BY conv_id""")
def sample_chunks(spark, sf_dir):
    """A conversation's turns sampled evenly within 100 estimated tokens."""
    ordered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    sampled = F.udf(lambda c: packing.sample([x["text"] for x in c], tokens=100), "string", useArrow=True)
    return ordered.select("conv_id", sampled("c").alias("sample"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS book FROM conversations GROUP BY conv_id")
def book_text(spark, sf_dir):
    return packing.joined_texts(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumnRenamed("text", "book")


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN '…' || right(replace(text, chr(10), ' '), 240) ELSE replace(text, chr(10), ' ') END AS snippet FROM documents")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("""WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 400 THEN trim(substring(t, length(t) // 4 + 1, 400), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE t END AS phrase FROM t""")
def search_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.search_phrase(F.col("text")).alias("phrase"))


MODELS = "CASE p_partkey % 4 WHEN 0 THEN p_brand || '/' || p_type || '-GGUF' WHEN 1 THEN ' ' || p_type || ':' || p_size || ' ' WHEN 2 THEN p_name || '-v' || p_size ELSE '--' END"


@query(f"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(CASE WHEN contains(m, '/') THEN m[strpos(m, '/') + 1:] ELSE m END, '-gguf$', '', 'i')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'model') AS model FROM (SELECT p_partkey, string_split(trim({MODELS}), ':')[1] AS m FROM part)")
def normalize_model(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr(MODELS).alias("m"))
    return named.select("p_partkey", values.normalize_model(F.col("m")).alias("model"))


@query(f"SELECT DISTINCT left('chunks_' || coalesce(nullif(lower(trim(regexp_replace({MODELS}, '[^A-Za-z0-9]+', '_', 'g'), '_')), ''), 'model'), 80) AS table_name FROM part")
def model_tables(spark, sf_dir):
    return table(spark, sf_dir, "part").select(values.model_table_name(F.expr(MODELS)).alias("table_name")).distinct()


RAW_VALUES = "CASE p_partkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN ' ' || p_type || ', ' || p_name || '. , ' WHEN 2 THEN NULL WHEN 3 THEN ' unknown ' WHEN 4 THEN p_name || ',' || p_brand ELSE '  ' END"


@query(f"""SELECT p_partkey, CASE WHEN e THEN '' ELSE trim(v) END AS text_value, CASE WHEN e THEN '' ELSE array_to_string(list_filter(list_transform(string_split(trim(v), ','), lambda x: trim(x, ' .')), lambda x: x <> ''), '|') END AS tags
FROM (SELECT p_partkey, v, v IS NULL OR trim(v) = '' OR lower(trim(v)) IN ('null', 'none', 'n/a', 'unknown') AS e FROM (SELECT p_partkey, {RAW_VALUES} AS v FROM part))""")
def normalize_value(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.expr(RAW_VALUES).alias("v"))
    return raw.select("p_partkey", values.text_value(F.col("v")).alias("text_value"), F.array_join(values.tags_value(F.col("v")), "|").alias("tags"))


RAW_TAG = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || ' (' || p_type || ')' WHEN 1 THEN replace(p_name, ' ', ' / ') WHEN 2 THEN replace(p_name, ' ', ' and ') WHEN 3 THEN '  ' || p_name || '  ' ELSE replace(p_name, ' ', '&') || ' (x) (y)' END"
TAG_KEY = r"coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '\s+', ' ', 'g'), '(\s*\([^()]*\))+\s*$', ''), '\s*([/&+]|\band\b)\s*', '|', 'g'), '\|+', '|', 'g'), '|'), ''), lower(trim(t)))"


@query(f"SELECT p_partkey, {TAG_KEY} AS key FROM (SELECT p_partkey, {RAW_TAG} AS t FROM part)")
def tag_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.tag_key(F.expr(RAW_TAG)).alias("key"))


@query(f"""WITH t AS (SELECT p_partkey // 25 AS list_no, p_partkey, trim({RAW_TAG}) AS t FROM part), k AS (SELECT list_no, p_partkey, t, {TAG_KEY} AS key FROM t),
b AS (SELECT list_no, key, min(p_partkey) AS seen, arg_min(t, length(t) * 1000000000000 + p_partkey) AS tag FROM k GROUP BY list_no, key)
SELECT list_no, string_agg(tag, '|' ORDER BY seen) AS tags FROM b GROUP BY list_no""")
def normalize_tags(spark, sf_dir):
    """Lists of the tags of 25 parts in order, each tag in one spelling."""
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 25).alias("list_no"), "p_partkey", F.expr(RAW_TAG).alias("tag"))
    lists = rows.groupBy("list_no").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "tag"))).alias("t"))
    return lists.select("list_no", F.array_join(values.normalize_tags(F.col("t.tag")), "|").alias("tags"))


@query("""WITH w AS (SELECT p_partkey, [p_name, upper(p_name), p_type, lower(p_type), p_brand] AS v FROM part)
SELECT p_partkey, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '|') AS kept FROM w""")
def distinct_values(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", F.upper("p_name"), "p_type", F.lower("p_type"), "p_brand").alias("v"))
    return rows.select("p_partkey", F.array_join(values.distinct_values(F.col("v")), "|").alias("kept"))


FORMATS = "CASE o_orderkey % 6 WHEN 0 THEN 'pdf,Epub' WHEN 1 THEN 'LRF,DJVU' WHEN 2 THEN 'lsf,lrf' WHEN 3 THEN '' WHEN 4 THEN 'txt,mobi,azw3' ELSE 'CBZ' END"


@query(f"""WITH f AS (SELECT o_orderkey, list_filter(string_split({FORMATS}, ','), lambda x: x <> '') AS f FROM orders), w AS (SELECT ['EPUB', 'AZW3', 'MOBI', 'FB2', 'DOCX', 'HTML', 'TXT', 'PDF'] AS w)
SELECT o_orderkey, coalesce(list_filter(list_transform(w, lambda p: list_filter(f, lambda x: upper(x) = p)[-1]), lambda x: x IS NOT NULL)[1], list_filter(f, lambda x: upper(x) NOT IN ('LSF', 'LRF'))[1], f[1]) AS fmt FROM f, w""")
def pick_format(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.filter(F.split(F.expr(FORMATS), ","), lambda x: x != "").alias("f"))
    return rows.select("o_orderkey", values.pick_format(F.col("f")).alias("fmt"))


def library(spark, sf_dir) -> dict[str, DataFrame]:
    """A library and its registries made of documents: which rows each has follows from the id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.col("n_chars").alias("n"), "lang")
    return {
        "library": docs.where("book_id % 11 <> 0").select("book_id", F.when(F.col("book_id") % 13 == 0, None).otherwise(F.when(F.col("book_id") % 7 == 0, "PDF").otherwise("EPUB")).alias("fmt"), (F.col("n") + (F.col("book_id") % 5 == 0).cast("int")).alias("size"), (F.lit(1_700_000_000) + F.col("book_id") + 0.75).alias("mtime")),
        "books": docs.where("book_id % 3 <> 0").select("book_id", F.lit("EPUB").alias("fmt"), F.lit(0).cast("long").alias("indexed_at"), F.least(F.floor(F.col("n") / 1000), F.lit(50)).cast("int").alias("n_chunks"), F.concat(F.lit("m_"), "lang").alias("model")),
        "file_info": docs.where("book_id % 4 <> 1").select("book_id", F.lit("EPUB").alias("fmt"), F.col("n").alias("size"), (F.lit(1_700_000_000) + F.col("book_id")).alias("mtime_s")),
        "failed": docs.where("book_id % 6 = 0").select("book_id", F.when(F.col("book_id") % 4 == 0, "attr").otherwise("index").alias("kind"), F.lit("e").alias("error")),
        "attrs": docs.where("book_id % 5 = 2").select("book_id", F.when(F.col("book_id") % 2 == 0, F.create_map(F.lit("b"), F.array(F.lit("y")), F.lit("a"), F.array(F.lit("x")))).otherwise(F.create_map(F.lit("a"), F.array(F.lit("x")))).alias("values")),
        "queue_index": docs.where("book_id % 17 = 0").select("book_id", (F.col("book_id") % 3).cast("int").alias("priority")),
        "queue_attrs": docs.where("book_id % 19 = 0").select("book_id", F.lit(100).alias("priority")),
    }


LIBRARY = """WITH d AS (SELECT doc_id AS book_id, n_chars AS n, lang FROM documents),
library AS (SELECT book_id, CASE WHEN book_id % 13 = 0 THEN NULL WHEN book_id % 7 = 0 THEN 'PDF' ELSE 'EPUB' END AS fmt, n + (book_id % 5 = 0)::INT AS size, 1700000000 + book_id AS mtime FROM d WHERE book_id % 11 <> 0),
books AS (SELECT book_id, 'EPUB' AS fmt, least(n // 1000, 50) AS n_chunks, 'm_' || lang AS model FROM d WHERE book_id % 3 <> 0),
file_info AS (SELECT book_id, 'EPUB' AS fmt, n AS size, 1700000000 + book_id AS mtime_s FROM d WHERE book_id % 4 <> 1),
failed AS (SELECT book_id, CASE WHEN book_id % 4 = 0 THEN 'attr' ELSE 'index' END AS kind FROM d WHERE book_id % 6 = 0),
attrs AS (SELECT book_id, CASE WHEN book_id % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END AS fields FROM d WHERE book_id % 5 = 2),
queue_index AS (SELECT book_id, book_id % 3 AS priority FROM d WHERE book_id % 17 = 0), queue_attrs AS (SELECT book_id, 100 AS priority FROM d WHERE book_id % 19 = 0),
known AS (SELECT book_id FROM books UNION SELECT book_id FROM file_info UNION SELECT book_id FROM failed UNION SELECT book_id FROM attrs UNION SELECT book_id FROM queue_index UNION SELECT book_id FROM queue_attrs)
"""


@query(LIBRARY + """SELECT l.book_id, 'index' AS action FROM library l LEFT JOIN books b USING (book_id) LEFT JOIN file_info i USING (book_id)
WHERE l.fmt IS NOT NULL AND CASE WHEN b.book_id IS NULL THEN NOT (l.book_id IN (SELECT book_id FROM failed WHERE kind = 'index') AND i.book_id IS NOT NULL AND i.fmt = l.fmt AND i.size = l.size AND i.mtime_s = l.mtime)
 WHEN i.book_id IS NULL THEN b.fmt <> l.fmt ELSE NOT (i.fmt = l.fmt AND i.size = l.size AND i.mtime_s = l.mtime) END
UNION ALL SELECT book_id, 'remove' FROM known WHERE book_id NOT IN (SELECT book_id FROM library)""")
def reconcile_actions(spark, sf_dir):
    tables = library(spark, sf_dir)
    return registry.reconcile(tables["library"], tables)


@query(LIBRARY + "SELECT book_id FROM known WHERE book_id NOT IN (SELECT book_id FROM library)")
def vanished_books(spark, sf_dir):
    tables = library(spark, sf_dir)
    return registry.vanished(tables["library"], tables)


@query(LIBRARY + "SELECT book_id, max(priority)::BIGINT AS priority FROM (SELECT * FROM queue_index UNION ALL SELECT book_id, 2 FROM d WHERE book_id % 34 = 0) GROUP BY book_id")
def priority_upsert(spark, sf_dir):
    tables = library(spark, sf_dir)
    more = table(spark, sf_dir, "documents").where("doc_id % 34 = 0").select(F.col("doc_id").alias("book_id"), F.lit(2).alias("priority"))
    return registry.enqueue(tables["queue_index"], more).withColumn("priority", F.col("priority").cast("long"))


@query(LIBRARY + "SELECT book_id, row_number() OVER (ORDER BY priority DESC, book_id DESC) AS place FROM queue_index QUALIFY place <= 25")
def queue_order(spark, sf_dir):
    """The next 25 books of the queue, numbered."""
    from pyspark.sql import Window as W

    top = registry.queue_order(library(spark, sf_dir)["queue_index"]).limit(25)
    return top.select("book_id", F.row_number().over(W.orderBy(F.desc("priority"), F.desc("book_id"))).cast("long").alias("place"))


@query(LIBRARY + """SELECT b.book_id FROM books b LEFT JOIN attrs a USING (book_id) WHERE b.n_chunks > 0 AND (a.fields IS NULL OR a.fields <> ['a', 'b'])
 AND b.book_id NOT IN (SELECT book_id FROM failed WHERE kind = 'attr')""")
def pending_attributes(spark, sf_dir):
    t = library(spark, sf_dir)
    return registry.pending_attributes(t["books"], t["attrs"], ["b", "a"], t["failed"])


@query(LIBRARY + """, p AS (SELECT b.book_id FROM books b LEFT JOIN attrs a USING (book_id) WHERE b.n_chunks > 0 AND (a.fields IS NULL OR a.fields <> ['a', 'b']))
SELECT book_id, forced, row_number() OVER (ORDER BY forced DESC, priority DESC NULLS LAST, book_id DESC) AS place FROM (SELECT book_id, bool_or(f) AS forced, max(priority) AS priority FROM (SELECT book_id, false AS f, NULL AS priority FROM p UNION ALL SELECT book_id, true, priority FROM queue_attrs) GROUP BY book_id)""")
def attribute_phase(spark, sf_dir):
    t = library(spark, sf_dir)
    ordered = registry.attribute_order(registry.pending_attributes(t["books"], t["attrs"], ["a", "b"]), t["queue_attrs"])
    return registry.numbered(ordered, F.desc("forced"), F.desc_nulls_last("priority"), F.desc("book_id")).select("book_id", "forced", "place")


@query(LIBRARY + """SELECT book_id FROM library WHERE fmt IS NOT NULL AND NOT (book_id IN (SELECT book_id FROM books WHERE n_chunks > 0) AND book_id NOT IN (SELECT book_id FROM failed WHERE kind = 'index'))""")
def new_and_failed(spark, sf_dir):
    t = library(spark, sf_dir)
    return registry.new_and_failed(t["library"], t["books"], t["failed"])


@query("""SELECT o_orderkey AS id, coalesce(n_name, '') AS fmt, coalesce(r_name, '') AS model FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 31 LEFT JOIN region ON r_regionkey = o_orderkey % 7""")
def registry_join(spark, sf_dir):
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 31).cast("int").alias("fmt_id"), (F.col("o_orderkey") % 7).cast("int").alias("model_id"))
    formats = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("fmt"))
    models = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("model"))
    return registry.named(books, formats, models).select("id", "fmt", "model")


@query(LIBRARY + "SELECT DISTINCT model FROM (SELECT 'm_' || lang AS model FROM d UNION SELECT 'old_' || lang FROM d) WHERE model NOT IN (SELECT model FROM books WHERE n_chunks > 0) AND model <> 'old_en'")
def stale_models(spark, sf_dir):
    t = library(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.lit("m_"), "lang").alias("model")).union(docs.select(F.concat(F.lit("old_"), "lang")))
    return registry.stale_models(chunks, t["books"], "old_en")


@query(LIBRARY + """, p AS (SELECT b.book_id FROM books b LEFT JOIN attrs a USING (book_id) WHERE b.n_chunks > 0 AND (a.fields IS NULL OR a.fields <> ['a', 'b']))
SELECT (SELECT count(*) FROM library) AS library, (SELECT count(*) FROM books) AS books, (SELECT sum(n_chunks)::BIGINT FROM books) AS chunks, (SELECT count(*) FROM books WHERE n_chunks > 0) AS with_chunks,
 greatest(0, (SELECT count(*) FROM books WHERE n_chunks > 0) - (SELECT count(*) FROM p)) AS attrs_done, (SELECT count(*) FROM failed WHERE kind = 'attr') AS attr_failures, (SELECT count(*) FROM failed WHERE kind = 'index') AS index_failures""")
def index_status(spark, sf_dir):
    t = library(spark, sf_dir)
    return registry.status(t["library"], t["books"], registry.pending_attributes(t["books"], t["attrs"], ["a", "b"]), t["failed"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'book ' || c_custkey ELSE '"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' by ' || c_mktsegment || ', B' END || ' [id ' || c_custkey || ']' END AS label FROM customer""")
def book_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    missing = F.col("c_custkey") % 5 == 0
    authors = F.when(missing, None).otherwise(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(""))).otherwise(F.array("c_mktsegment", F.lit(""), F.lit("B"))))
    return rows.select("c_custkey", text.book_label(F.col("c_custkey"), F.when(~missing, F.col("c_name")), authors).alias("label"))


@query("SELECT s_nationkey::BIGINT AS nation, string_agg('id:' || s_suppkey, ' or ' ORDER BY s_suppkey) AS expression FROM supplier GROUP BY s_nationkey")
def restrict_expression(spark, sf_dir):
    grouped = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.collect_list("s_suppkey").alias("ids"))
    return grouped.select("nation", text.restrict_expression(F.col("ids")).alias("expression"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, epoch(ts)::BIGINT - CASE WHEN extract('microsecond' FROM ts) % 1000000 >= 500000 AND epoch(ts)::BIGINT > epoch_us(ts) // 1000000 THEN 1 ELSE 0 END AS mtime_s FROM events WHERE json_valid(props)")
def file_times(spark, sf_dir):
    """Timestamps cut to whole seconds, and a number out of a JSON text."""
    rows = table(spark, sf_dir, "events")
    return rows.where(F.try_parse_json("props").isNotNull()).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), values.epoch_seconds(F.col("ts")).alias("mtime_s"))


INFO = "CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE o_orderstatus || '|' || o_custkey || '|' || (1598092103 + o_orderkey) || '.694143' END"


@query(f"SELECT o_orderkey, p[1] AS fmt, p[2]::BIGINT AS size, floor(p[3]::DECIMAL(38, 9))::BIGINT AS mtime_s FROM (SELECT o_orderkey, string_split({INFO}, '|') AS p FROM orders) WHERE len(p) = 3")
def legacy_file_info(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", values.legacy_file_info(F.expr(INFO)).alias("i"))
    return rows.where("i is not null").select("o_orderkey", "i.fmt", "i.size", "i.mtime_s")


@query("SELECT s_suppkey AS book_id, s_name AS error FROM supplier WHERE s_suppkey % 3 <> 0")
def legacy_failures(spark, sf_dir):
    body = F.when(F.col("s_suppkey") % 3 == 0, F.lit('"x": {"error": "lost"}')).otherwise(F.concat(F.lit('"'), F.col("s_suppkey").cast("string"), F.lit('": {"error": "'), F.col("s_name"), F.lit('"}')))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("{"), body, F.lit("}")).alias("j"))
    return rows.select(F.explode(values.legacy_failures(F.col("j"))).alias("f")).select("f.book_id", "f.error")


@query(f"""WITH r AS (SELECT p_partkey, unnest([{RAW_TAG}, p_type, p_brand]) AS t FROM part), k AS (SELECT p_partkey, t, {TAG_KEY} AS key FROM r)
SELECT key, arg_min(t, (length(t), t)) AS tag, count(DISTINCT p_partkey) AS n FROM k GROUP BY key""")
def tag_totals(spark, sf_dir):
    """How many books have each tag, over all spellings."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.create_map(F.lit("t"), F.array(F.expr(RAW_TAG), "p_type", "p_brand")).alias("values"))
    return attributes.tag_counts(rows, "t")


@query("SELECT doc_id, quality::BIGINT AS quality, list_sort(['q' || quality, 't' || toxic]) = ['q1', 't0'] AS complete FROM labels")
def field_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.create_map(F.concat(F.lit("t"), "toxic"), F.array(), F.concat(F.lit("q"), "quality"), F.array()).alias("v"))
    return rows.select("doc_id", "quality", registry.field_set(F.col("v")).eqNullSafe(F.array(F.lit("q1"), F.lit("t0"))).alias("complete"))


@query("SELECT c_custkey, greatest(200, trunc((c_custkey + 64) / 0.25::DOUBLE))::BIGINT AS chunk_chars, greatest(2000, trunc((c_custkey - 896) / 0.2::DOUBLE))::BIGINT AS text_chars FROM customer")
def chunk_budgets(spark, sf_dir):
    """Characters of a chunk and of a request for context sizes from 129 tokens on."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") + 128).alias("context"))
    return rows.select("c_custkey", text.chunk_chars(F.col("context"), 1.25).alias("chunk_chars"), text.budget_chars(F.col("context")).alias("text_chars"))


@query("SELECT 32512::BIGINT AS chunk_chars, 35840::BIGINT AS text_chars, count(*) AS n FROM documents WHERE length(text) > 35840")
def long_books(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > text_budget_chars(8192))
    return docs.agg(F.lit(max_chunk_chars(8192, 1.25)).cast("long").alias("chunk_chars"), F.lit(text_budget_chars(8192)).cast("long").alias("text_chars"), F.count("*").alias("n"))


def in_two_runs(changes: DataFrame, keys: list[str], highest: bool = False) -> DataFrame:
    """Changes in order as two merged runs."""
    return keyed.folded(changes.where("_seq < 5000"), keys, highest).unionByName(keyed.folded(changes.where("_seq >= 5000"), keys, highest))


@query("""WITH last AS (SELECT user_id AS k, max_by({'v': value, 't': event_type}, event_id) AS e FROM events GROUP BY user_id)
SELECT k, e.v AS v FROM last WHERE e.t <> 'error' UNION ALL SELECT c_custkey, c_acctbal::DOUBLE FROM customer WHERE c_custkey NOT IN (SELECT k FROM last)""")
def replay_changes(spark, sf_dir):
    """A table of customers after every event has put its value under its user, or, as an error, taken the row away."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("v"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("value").alias("v"), "event_id", "event_type")
    put = keyed.puts(events.where("event_type <> 'error'").select("k", "v", "event_id"), F.col("event_id")).drop("event_id")
    failed = events.where("event_type = 'error'")
    gone = keyed.drops(failed.select("k", "event_id"), base.schema, ["k"], F.col("event_id"))
    return keyed.merged(base, in_two_runs(put.unionByName(gone), ["k"]), ["k"])


@query("""WITH last AS (SELECT user_id AS k, coalesce(max(event_id) FILTER (WHERE event_type = 'error'), -1) AS cut FROM events GROUP BY user_id),
live AS (SELECT user_id AS k, floor(value)::BIGINT AS priority FROM events JOIN last ON k = user_id WHERE event_id > cut UNION ALL SELECT c_custkey, c_custkey % 50 FROM customer WHERE c_custkey NOT IN (SELECT k FROM last WHERE cut >= 0))
SELECT k, max(priority) AS priority FROM live GROUP BY k""")
def replay_queue(spark, sf_dir):
    """A queue of customers after every event has raised its user to the event's priority, or, as an error, taken the user out."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 50).cast("long").alias("priority"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.floor("value").cast("long").alias("priority"), "event_id", "event_type")
    up = keyed.raises(events.where("event_type <> 'error'").select("k", "priority", "event_id"), F.col("event_id")).drop("event_id")
    out = keyed.drops(events.where("event_type = 'error'").select("k", "event_id"), base.schema, ["k"], F.col("event_id"))
    return keyed.merged(base, in_two_runs(up.unionByName(out), ["k"], True), ["k"], True)
