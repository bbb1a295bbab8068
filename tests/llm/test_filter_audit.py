"""The audit of filters against SQL, and against applying every order to every text."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import compare
from edges import empty, rows
from glyphlake.llm import filter_audit, queries


def fails(docs):
    """(id, part, letters) of each (id, text, part)."""
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(firsts.get(text or "", i), i)
    for i, text, part in docs:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        bad = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        yield i, part or "", bad + "E" * (i is not None and firsts[text] < i)


def plain(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    cells, shapley = defaultdict(Counter), Counter()
    parts = {part or "" for _, _, part in docs}
    for order in map("".join, permutations("ABCDE")):
        for i, part, bad in fails(docs):
            for k, f in enumerate(order):
                cell, earlier = cells[part, order, k + 1], set(order[:k]) & set(bad)
                cell["kept"] += not earlier and f not in bad
                cell["redundant"] += f in bad and bool(earlier)
                cell["unique"] += bad == f
                if f in bad and not earlier:
                    cell["removed"] += 1
                    shapley[part, f] += 1
                    cell["good"] += i in good
                    cell["toxic"] += i in toxic
    names = ("kept", "removed", "redundant", "unique", "good", "toxic")
    return sorted((p, o, s, *(cells[p, o, s][n] for n in names), shapley[p, o[s - 1]]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6))


WORDS = [f"w{i}" for i in range(80)]
DOCS = [
    (1, " ".join(WORDS), "a"), (2, " ".join(WORDS), "a"), (2, " ".join(WORDS), "b"), (3, " ".join(WORDS[:10] * 8), "a"), (4, "SHORT & LOUD", None), (5, None, ""), (6, "", "b"), (None, "", "b"), (None, None, None),
    (7, " ".join(WORDS) + " #", "b"), (8, " ".join(w.upper() for w in WORDS), "b"), (9, " ".join(w.upper() for w in WORDS[:5] * 20) + "|", "a"), (0, "short\x0bwords here", "a"), (10, "É " * 60, "c"), (4, "SHORT & LOUD", None), (11, " ".join(f"x{i}" for i in range(30_000)) + "$", "c"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (4, 0, 1), (None, 1, 1), (7, 1, 1), (7, 1, 1), (99, 1, 1)]


def frames(spark, docs, labels):
    df = rows(spark, [(i, t) for i, t, _ in docs]) if docs else empty(spark)
    both = spark.createDataFrame(docs, "doc_id long, text string, source string") if docs else df.selectExpr("doc_id", "text", "cast(null as string) as source")
    return both.selectExpr("*", "1 as id", "'p' as part", "2 as mask", "3 as n", "4 as quality", "'d' as digest", "5 as `rows`"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as q", "2 as t", "3 as part", "4 as id")


def test_same_as_sql(spark, sf_dir):
    assert compare.same(queries.op13_filter_audit(spark, sf_dir), queries.ORACLES["op13_filter_audit"], sf_dir)[2]


def test_every_order_applied_one_by_one(spark):
    got = filter_audit.audit(*frames(spark, DOCS, LABELS))
    assert sorted(map(tuple, got.collect())) == plain(DOCS, LABELS)


def test_no_labels_and_no_documents(spark):
    got = filter_audit.audit(*frames(spark, DOCS, []))
    assert sorted(map(tuple, got.collect())) == plain(DOCS, [])
    assert filter_audit.audit(*frames(spark, [], LABELS)).count() == 0


def test_many_copies_are_counted_not_gathered(spark):
    docs = [(i, "the same text" if i % 3 else f"another {i}", f"s{i % 4}") for i in range(600)]
    got = filter_audit.audit(*frames(spark, docs, [(i, i % 2, 1) for i in range(600)]))
    assert sorted(map(tuple, got.collect())) == plain(docs, [(i, i % 2, 1) for i in range(600)])


def test_matrices_are_a_partition():
    found = filter_audit.outcome_matrices()
    assert {m.shape for m in found.values()} == {(32, 600)}
    gone_before = 1 - found["kept"] - found["removed"] - found["redundant"]
    assert set(gone_before.ravel().tolist()) == {0, 1} and (found["unique_fails"].sum(0) == 1).all()
    assert (found["removed"].reshape(32, 120, 5).sum(2) + found["kept"].reshape(32, 120, 5)[:, :, 4] == 1).all()
