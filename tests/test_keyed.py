"""Keyed tables with changes on top: against dictionaries, at every way of merging, and what a change writes."""

import os
import random

import pytest

from glyphlake.engine import VectorStore
from glyphlake.operators import keyed

KIND = "k long, kind string, v map<string,array<string>>, n int"


def replay(base, changes, highest):
    held = dict(base)
    for _, op, key, value in sorted(changes):
        if op == "drop":
            held.pop(key, None)
        else:
            held[key] = max(held[key], value) if highest and op == "raise" and key in held else value
    return held


def as_rows(spark, items):
    return spark.createDataFrame([(k, kind, None if n is None else {"n": [str(n)]}, n) for (k, kind), n in items], KIND)


def as_changes(spark, changes, highest):
    empty = as_rows(spark, [])
    out = None
    for seq, op, key, value in changes:
        row = as_rows(spark, [(key, value)])
        one = keyed.drops(row, empty.schema, ["k", "kind"], seq) if op == "drop" else keyed.raises(row, seq) if op == "raise" else keyed.puts(row, seq)
        out = one if out is None else out.unionByName(one)
    return out


@pytest.mark.parametrize("highest", [False, True])
def test_same_as_a_dictionary(spark, highest):
    r = random.Random(7 + highest)
    keys = [(k, kind) for k in (1, 2, None) for kind in ("a", None)]
    base = {k: r.randint(0, 9) for k in keys[:4]}
    changes = [(s, r.choice(["drop", "raise"] if highest else ["put", "drop"]), r.choice(keys), r.randint(0, 20)) for s in range(24)]
    rows = as_rows(spark, base.items())
    rows = rows.drop("v") if highest else rows
    made = as_changes(spark, changes, highest)
    made = made.drop("v") if highest else made
    want = replay(base, changes, highest)
    read = lambda df: {(x["k"], x["kind"]): x["n"] for x in df.collect()}
    got = keyed.merged(rows, made, ["k", "kind"], highest)
    assert got.columns == rows.columns and read(got) == want and got.count() == len(want)
    cut = 11  # changes that were folded before are the same changes
    parts = keyed.folded(made.where(f"_seq < {cut}"), ["k", "kind"], highest).unionByName(keyed.folded(made.where(f"_seq >= {cut}"), ["k", "kind"], highest))
    assert read(keyed.merged(rows, parts, ["k", "kind"], highest)) == want
    assert read(keyed.merged(rows, made.limit(0), ["k", "kind"], highest)) == base
    assert read(keyed.merged(rows.limit(0), made, ["k", "kind"], highest)) == replay({}, changes, highest)


def test_equal_places(spark):
    row = spark.createDataFrame([(1, "b"), (1, "a")], "k long, v string")
    both = keyed.puts(row, 5).unionByName(keyed.drops(row, row.schema, ["k"], 5))
    assert [tuple(x) for x in keyed.merged(row.limit(0), both, ["k"]).collect()] == [(1, "b")]


def test_when_to_merge():
    assert keyed.run_due([], 2) == 0 and keyed.run_due([0], 2) == 0 and keyed.run_due([1, 0, 0], 2) == 2 and keyed.run_due([1, 1, 0], 2) == 0
    assert not keyed.base_due(100, 60, 80) and keyed.base_due(100, 90, 80) and not keyed.base_due(1000, 400, 80)


def sizes(path):
    return {f: sum(os.path.getsize(os.path.join(d, x)) for d, _, files in os.walk(os.path.join(path, f)) for x in files) for f in os.listdir(path) if os.path.isdir(os.path.join(path, f))}


def test_a_change_costs_the_same_on_any_table(spark, tmp_path):
    cost = {}
    for n in (20_000, 400_000):
        store = VectorStore(spark, str(tmp_path / str(n)), grace=0)
        store.publish(file_info=spark.range(n).selectExpr("id AS book_id", "concat('F', id % 7) AS fmt", "id * 7919 AS size", "id AS mtime_s"))
        was = sizes(store.path)
        store.set_file_info(5, "EPUB", 17, 3)
        store.clear_file_info(7)
        now = sizes(store.path)
        assert {f: b for f, b in now.items() if f in was} == was  # nothing that was there is written again
        cost[n] = sum(b for f, b in now.items() if f not in was)
        assert store.get_file_info(5)["size"] == 17 and store.get_file_info(7) is None and store.table("file_info").count() == n - 1
    assert cost[20_000] == cost[400_000]


def test_a_store_over_many_changes(spark, tmp_path, monkeypatch):
    """Random calls against dictionaries, with runs of two merged and the base written now and then."""
    monkeypatch.setattr(keyed, "FAN", 2)
    monkeypatch.setattr(keyed, "LEAST", 9000)
    store, r = VectorStore(spark, str(tmp_path / "s"), grace=0), random.Random(3)
    info, queue, failed = {}, {}, {}
    for step in range(24):
        b, p, op = r.randint(1, 4), r.randint(0, 9), r.randint(0, 6)
        if op == 0:
            store.set_file_info(b, "F", p, step)
            info[b] = p
        elif op == 1:
            store.clear_file_info(b)
            info.pop(b, None)
        elif op <= 3:
            store.enqueue_indexing_many([b, b + 1], p)
            queue |= {x: max(p, queue.get(x, p)) for x in (b, b + 1)}
        elif op == 4:
            store.dequeue_many("queue_index", [b])
            queue.pop(b, None)
        elif op == 5:
            store.set_failed(b, r.choice(["index", "attr"]) if step % 2 else "index", f"e{step}")
            failed = {(x["book_id"], x["kind"]): x["error"] for x in store.failed_entries()}
            assert f"e{step}" in failed.values()
        else:
            store.clear_failed(b)
            failed = {k: v for k, v in failed.items() if k[0] != b}
    assert {x["book_id"]: x["size"] for x in store.table("file_info").collect()} == info
    assert {x["book_id"]: x["priority"] for x in store.table("queue_index").collect()} == queue
    assert {(x["book_id"], x["kind"]): x["error"] for x in store.failed_entries()} == failed
    assert store.queued_indexing_book_ids() == sorted(queue, key=lambda b: (-queue[b], -b))
    named = [f for e in store._read("manifest.json")["tables"].values() for f in store._folders(e)]
    retired = {x[0] for x in store._read("manifest.json")["retired"]}
    assert len(named) == len(set(named)) < 24 and set(sizes(store.path)) <= {*named, *retired} and store.get_file_info(99) is None
