"""The pipeline's stages against brute force over their own inputs."""

import re

import corpus_pipeline
import edges
from glyphlake.llm import pii, toxicity
from test_near_dedup import brute
from test_other_operators import shingled
from test_tokens import PLAIN


def written(spark, tmp_path, docs, items=None):
    """The tables of a run over these documents; a few of them are labelled."""
    home = tmp_path / "tables"
    docs.write.mode("overwrite").parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items or [], "item_id long, text string").write.mode("overwrite").parquet(f"{home}/benchmark.parquet")
    return str(home)


def test_edges(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing names; then empty tables."""
    docs = edges.rows(spark).selectExpr("*", "'en' as lang", "null as source", "cast(length(text) as long) as n_chars")
    home = written(spark, tmp_path, docs, [(1, "two three four five six"), (2, None)])
    held = spark.read.parquet(f"{home}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, home)
        held.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        assert held.columns == docs.columns, name
    got = corpus_pipeline.run(spark, home)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = {r["doc_id"] for r in got.collect()}
    assert kept == {r["doc_id"] for r in held.collect()} and {None, 2, 3, 4, 5, 7, 8} >= kept and 1 not in kept and got.count() == held.count()
    assert corpus_pipeline.run(spark, written(spark, tmp_path, docs.limit(0))).count() == 0


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], sf_dir).write.parquet(str(tmp_path / name))
        held.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == names for d in held[:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in held]

    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.score(docs, model).collect()
    assert set(rows[1]) == {r["doc_id"] for r in scores if r["score"] < toxicity.THRESHOLD} and all(rows[1][i] == rows[0][i] for i in rows[1])

    found = brute([(i, r["text"]) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, (_, c) in found.items() if c == i} and len(rows[2]) < len(rows[1])

    items = [shingled(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, r in rows[2].items() if any(100 * len(s & shingled(r["text"])) >= 75 * len(s) for s in items)}
    assert set(rows[3]) == set(rows[2]) - leaks

    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not re.search(r"\[(EMAIL|IP|CARD|PHONE|CONTEXT)\]", r["text"]):
            assert r["text"] == rows[3][i]["text"]

    assert {i: r["n_tokens"] for i, r in rows[5].items()} == {i: len(PLAIN.encode_ordinary(r["text"])) for i, r in rows[4].items()}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows[5])
