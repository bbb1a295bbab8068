"""What the plans of the operators read, shuffle and run outside the JVM."""

from glyphlake.llm import queries


def plan(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op9_decontamination", "op10_url_filter"):
        text = plan(spark, sf_dir, name)
        assert not any(x in text for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name


def test_scans_read_two_columns_and_shuffle_nothing(spark, sf_dir):
    for name in ("op1_token_counts", "op2_secret_scan", "op3_byte_bpe", "op6_pii"):
        text = plan(spark, sf_dir, name)
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "Exchange" not in text, name


def test_fingerprints_shuffle_texts_once(spark, sf_dir):
    text = plan(spark, sf_dir, "op4_fingerprints")
    assert text.count("Exchange hashpartitioning(range") == 1 and "SinglePartition" not in text
