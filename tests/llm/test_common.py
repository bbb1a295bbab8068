"""What the operators share: slices of batches, joins that split hot keys, scratch tables."""

import os
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

import edges
from glyphlake.llm import bpe, common, pii, secret_scan, token_counts


@pytest.mark.parametrize("limit", [1, 50, 1000, 1 << 20])
def test_slices_are_bounded_and_whole(limit):
    r = random.Random(limit)
    texts = [None if r.random() < 0.1 else "é" * r.randint(0, 60) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["id", "text"])
    cut = list(common.sliced([batch.slice(7), batch.slice(0, 0), batch], 1, limit))
    assert [t for b in cut for t in b.column(1).to_pylist()] == texts[7:] + texts
    size = lambda b: sum(len((t or "").encode()) for t in b.column(1).to_pylist())
    assert all(size(b) <= limit or b.num_rows == 1 or size(b) == max(len((t or "").encode()) for t in b.column(1).to_pylist()) for b in cut)


@pytest.mark.parametrize("module,work,arguments", [(secret_scan, secret_scan.scan, {}), (token_counts, token_counts.count_tokens, {}), (bpe, bpe.encode_documents, {"decode": True}), (pii, pii.find_pii, {})])
def test_operators_work_on_slices(spark, monkeypatch, module, work, arguments):
    """With slices of a few bytes the results are the same; so the operators take slices, whatever Spark hands over."""
    rows = lambda df: sorted((str(r["doc_id"]), *map(str, r[1:])) for r in df.collect())
    want = rows(work(edges.rows(spark), **arguments))
    seen = spark.sparkContext.accumulator(0)

    def small(batches, at=1, limit=0):
        for b in common.sliced(batches, at, 16):
            seen.add(1)
            yield b

    monkeypatch.setattr(module, "sliced", small)
    assert rows(work(edges.rows(spark), **arguments)) == want


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_split_join_is_a_join(spark, how):
    rows = spark.range(4000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as k", "id as x")
    table = rows.where("k is not null").groupBy("k").count().selectExpr("k", "count as n", "k * 2 as y").where("k = 7 or k % 2 = 0")
    plain = rows.join(table.drop("n"), "k", how)
    got = common.split_join(rows, table, "k", "n", how)
    assert set(got.columns) == set(plain.columns) and sorted(map(repr, got.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_scratch_tables_go(spark):
    df = common.save(spark.range(3), "test")
    path = df._scratch_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3
    common.drop_saved(df)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, *_: None if "checkpoint" in key else "/w"), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("local[4]")) == "/w/checkpoints"
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))


def test_unused_names(spark):
    assert common.unused("gone", spark.range(1)) == "gone" and common.unused("ID", spark.range(1)) == "ID_"
