"""The Jaccard join against all pairs: on tables, on planted links at the threshold, hot keys, odd rows; and its signatures."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import compare
from edges import LONG, ROWS, empty, rows
from glyphlake.llm import jaccard_join, partenum, queries


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain(docs, percent=80):
    """Sorted (id, n, component) by all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    least = {i: i for i, _ in docs if i is not None}
    groups = [{i for i, _ in docs if i is not None and i == j} for j in least]
    for x, (i, s) in enumerate(sets):
        for j, t in sets[x + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                groups.append({i, j})
    changed = True
    while changed:
        changed = False
        for g in groups:
            low = min(least[i] for i in g)
            for i in g:
                if least[i] != low:
                    least[i], changed = low, True
    return sorted(((i, len(s), least.get(i)) for i, s in sets), key=repr)


def check(spark, docs, **more):
    df = rows(spark, docs)
    got = jaccard_join.join_similar(df, **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, more.get("percent", 80))


def test_same_as_sql(spark, sf_dir):
    assert compare.same(queries.op11_jaccard_join(spark, sf_dir), queries.ORACLES["op11_jaccard_join"], sf_dir)[2]


def test_odd_rows(spark):
    check(spark, [*ROWS, (9, LONG + " one more"), (10, "a b c"), (11, "A B C"), (12, "a b c d e"), (13, "a b c d"), (14, "one TWO three four five six seven"), (15, None)])
    assert jaccard_join.join_similar(empty(spark)).count() == 0


def test_rows_of_one_id_bring_their_links(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    check(spark, [(5, a), (5, b), (7, b), (9, b + " more"), (2, "something else entirely here now"), (11, a + " other words")])


def at_threshold(rng, n, percent, off):
    """Two texts whose sets have about this similarity: the second goes on with other words from some place."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
    keep = n - round(n * (100 - percent) / (100 + percent)) + off
    return " ".join(words), " ".join(words[: keep + 4] + [f"v{rng.randrange(10**9)}" for _ in range(n - keep)])


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_links_at_the_threshold(spark, percent):
    rng, docs = random.Random(percent), []
    for n in (1, 2, 3, 5, 8, 9, 13, 21, 40, 90, 200, 500):
        for off in (-1, 0, 1):
            for text in at_threshold(rng, n, percent, off):
                docs.append((len(docs), text))
            docs.append((len(docs), " ".join(docs[-1][1].split()[: max(1, (n + 4) * percent // 100 + off)])))
    check(spark, docs, percent=percent)


@pytest.mark.parametrize("pairs", [0, 2])
def test_passages_chains_and_copies_in_small_blocks(spark, monkeypatch, pairs):
    """Also where every block has too many pairs, and where the first round sees next to nothing."""
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    monkeypatch.setattr(jaccard_join, "FIRST", 8 if pairs else 1000)
    monkeypatch.setattr(jaccard_join, "SMALL", 8 if pairs else 2)
    monkeypatch.setattr(jaccard_join, "CROWD", 20 if pairs else 4)
    monkeypatch.setattr(jaccard_join, "HELD", 1 << 20 if pairs else 50)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(20)] + passage + [f"y{rng.randrange(10**6)}" for _ in range(20)])) for i in range(120)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(60):
        docs.append((1000 - i, " ".join(chain)))
        chain = chain[4:] + [f"d{i}-{k}" for k in range(4)]
    docs += [(2000 + i, docs[i % 7][1]) for i in range(50)]
    check(spark, docs, block=16, block_bytes=1 << 14, broadcast_bytes=1000)


def test_batches_meet_like_one(spark, monkeypatch):
    """Few signatures a batch: every signature is packed many times, and those that several nodes of a batch share go out whole."""
    rng = random.Random(5)
    base = [[f"b{g}-{i}" for i in range(80)] for g in range(6)]
    docs = []
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(80)] = f"r{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    found = []
    for batch in (40, 1 << 21):
        df = rows(spark, docs).coalesce(2)
        monkeypatch.setattr(jaccard_join, "BATCH", batch)
        packed = jaccard_join.packed_signatures(df, "doc_id", "text", 80, 5)
        met = jaccard_join.meetings(packed).collect()
        together = {}
        for r in met:
            if r.bucket is not None:
                together.setdefault(r.bucket, set()).add(r.key)
        found.append({frozenset(p) for keys in together.values() for p in combinations(keys, 2)} | {frozenset((r.key, r.other)) for r in met if r.bucket is None})
    assert found[0] == found[1] and found[0]


def jaccard_sets(rng, n, percent):
    common = [rng.getrandbits(64) for _ in range(n)]
    k = 2 * n * (100 - percent) // (100 + percent)
    a = k // 2
    x = common + [rng.getrandbits(64) for _ in range(a)]
    y = common + [rng.getrandbits(64) for _ in range(k - a)]
    return (np.unique(np.array(v, np.uint64)) for v in (x, y))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.sampled_from([50, 60, 75, 80, 90, 99]), st.randoms(use_true_random=False))
def test_similar_sets_share_a_signature(n, percent, rng):
    bands = partenum.Bands(percent)
    x, y = jaccard_sets(rng, n, percent)
    common = len(np.intersect1d(x, y))
    if 100 * common >= percent * (len(x) + len(y) - common) and len(np.setxor1d(x, y)):
        assert len(np.intersect1d(partenum.signatures(x, bands), partenum.signatures(y, bands)))
        bits = jaccard_join.folded([jaccard_join.bitmap(x), jaccard_join.bitmap(y)])
        apart = jaccard_join.differ(bits[0], bits[1])
        assert apart <= len(np.setxor1d(x, y)) and jaccard_join.may_link(apart, len(x) + len(y), percent)


def test_adversarial_differences_share_a_signature():
    """Differences where they do most harm: two pieces of as many parts as they can break."""
    bands, rng = partenum.Bands(80), np.random.default_rng(1)
    for n in (20, 45, 100, 300):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for instance in bands.of(len(x)):
            gone, broken = [], {}
            spread = partenum.mixed(x ^ partenum.mixed(np.array([(instance.at << 8) + 1], np.uint64)))
            cell = ((spread >> np.uint64(32)) * np.uint64(3 * instance.parts) >> np.uint64(32)).astype(int)
            k = len(x) - -(-80 * len(x) // 100)  # subsets of x with enough of it
            for f, c in zip(x, cell, strict=True):
                if len(gone) < k and c % 3 not in broken.get(c // 3, set()) and len(broken.get(c // 3, set())) < 2:
                    broken.setdefault(c // 3, set()).add(c % 3)
                    gone.append(f)
            y = np.setdiff1d(x, np.array(gone, np.uint64))
            assert len(np.intersect1d(partenum.signatures(x, bands), partenum.signatures(y, bands)))


def test_unlike_sets_rarely_share_one():
    bands, rng = partenum.Bands(80), np.random.default_rng(2)
    found = [partenum.signatures(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)), bands) for n in range(60, 400)]
    every = np.concatenate(found)
    assert len(np.unique(every)) == len(every)


def test_short_bitmaps_rule_out_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    near, far = np.concatenate([base[:370], rng.integers(0, 1 << 63, 30).astype(np.uint64)]), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [base, near, far, base[:300], far[:3]]
    whole = [jaccard_join.bitmap(s) for s in sets]
    short = [jaccard_join.shortened(b) for b in whole]
    for i in range(len(sets)):
        for j in range(i):
            lower = int(jaccard_join.differ(*(np.frombuffer(short[k], np.uint64) for k in (i, j))))
            assert lower <= int(jaccard_join.differ(*jaccard_join.folded([whole[i], whole[j]]))) <= len(np.setxor1d(sets[i], sets[j]))
    members = [(k, k, len(s), short[k]) for k, s in enumerate(sets)]
    groups = spark.createDataFrame([([members[k] for k in (0, 1, 2)],), ([members[k] for k in (4, 1, 0)],), ([(0, 7, 400, short[0]), (1, 7, 400, short[1])],)], "members array<struct<key:long,label:long,n:long,short:binary>>")
    assert {tuple(r) for r in jaccard_join.apart_pairs(groups, 80).distinct().collect()} == {(0, 1)}
    assert jaccard_join.apart_pairs(groups.where("false"), 80).isEmpty()
