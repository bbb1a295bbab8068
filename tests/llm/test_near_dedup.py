import random
from collections import defaultdict

import numpy as np
import pytest

import compare
import edges
from glyphlake.llm import components, near_dedup, queries, setsketch


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=75):
    """Least reachable id and size of the set, by all pairs."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in keys}


def corpus(seed, groups=12, size=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice((3, 6, 40, 150)))]
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own) if r.random() < 0.8 else "  ".join(own).upper() + "\n")
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 4), (3, 2)])
def test_components_are_those_of_all_pairs(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.find_duplicates(df, block=block, broadcast_bytes=10 if block == 2 else 1 << 20).collect()}
    assert got == brute(rows)


def test_query_is_its_sql(spark, sf_dir):
    assert compare.same(queries.op7_near_dedup(spark, sf_dir), queries.ORACLES["op7_near_dedup"], sf_dir)[2]


def test_threshold_is_inclusive(spark):
    words = [f"w{i}" for i in range(11)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:9] + ["x", "y"])), (3, "a b c d"), (4, "A  b c\nD"), (5, "a b c e")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()} and got[4] == 3 and got[5] == 5


def test_edges(spark):
    got = near_dedup.find_duplicates(edges.rows(spark)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(3, 1, True)] * 2 and by[2] == [(0, 2, True)]
    assert by[3] == [(0, 3, True)] and by[5] == [(0, 5, True)] and by[None][0][1:] == (None, True) and (3, 1, False) in by[6] and len(got) == len(edges.ROWS)
    assert near_dedup.find_duplicates(edges.empty(spark)).count() == 0
    kept = near_dedup.keep_one(edges.rows(spark), near_dedup.find_duplicates(edges.rows(spark)))
    assert kept.columns == edges.rows(spark).columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in kept.collect()) == [(0, "text with"), (1, "one two t"), (2, ""), (3, ""), (4, edges.LONG[:9]), (5, " \n\t "), (7, "é字\U0001F600 \x00 ß"), (8, "short")]


@pytest.mark.parametrize("percent,block", [(40, 1024), (60, 1024), (60, 3), (75, 1024), (90, 1024)])
def test_every_threshold_finds_its_links(spark, percent, block):
    r = random.Random(percent)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for k in range(60):
        base = [word() for _ in range(r.choice((60, 200)))]
        other = list(base)
        # a changed word takes five shingles: similarities lie around the threshold, on both sides
        want = (percent + r.choice((-6, -2, 2, 6, 12))) / 100
        lost = round(len(base) * (1 - want) / (1 + want))
        other[: lost] = [word() for _ in range(lost)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.find_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, block=block).collect()}
    want = {i: c for i, (_, c) in brute(rows, percent).items()}
    assert got == want and 15 < sum(i != c for i, c in want.items()) < 60


def test_band_settings_miss_little():
    for percent in range(20, 101):
        b = setsketch.bands_for(percent)
        equal = setsketch.equal_share(percent / 100)
        assert b.rows * b.bands <= setsketch.REGISTERS and (1 - equal**b.rows) ** b.bands <= 1.0001e-4 and b.likely < percent / 100


@pytest.mark.parametrize("block", [8, 1024])
def test_groups_that_are_nearly_alike_stay_apart(spark, block):
    """A hub, its satellites, and a group whose members are alike but not enough: links of all pairs, none more."""
    r = random.Random(block)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # about 0.7 alike to one another
        own = list(words)
        for k in r.sample(range(0, 200, 5), 4):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    hub = [f"h{i}" for i in range(300)]
    rows += [(100 + i, " ".join([*hub, *(f"s{i}_{k}" for k in range(60))])) for i in range(30)] + [(99, " ".join(hub))]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.find_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,2)", "date", "double", "boolean", "binary", "timestamp"])
def test_ids_of_any_type(spark, kind):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (0, text + " more"), (0, "something else")], "k int, text string")
    as_kind = f"timestamp_seconds(k)" if kind == "timestamp" else "date_from_unix_date(k)" if kind == "date" else f"cast(cast(k as string) as binary)" if kind == "binary" else f"cast(k as {kind})"
    df = df.selectExpr(f"{as_kind} as doc_id", "text")
    found = near_dedup.find_duplicates(df)
    assert found.schema["doc_id"].dataType == found.schema["component_id"].dataType == df.schema["doc_id"].dataType
    assert sorted((x["n_shingles"], x["kept"]) for x in found.collect()) == [(1, True), (36, False), (37, True)]
    assert near_dedup.keep_one(df, found).count() == 1


def test_columns_of_any_names_are_kept(spark):
    df = edges.rows(spark).selectExpr("*", "1 as gone", "2 as again", "3 as rows", "4 as kept", "5 as GONE_", "6 as leaking", "7 as wanted")
    kept = near_dedup.keep_one(df, near_dedup.find_duplicates(df))
    assert kept.columns == df.columns and kept.count() == 8


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("swapped", [False, True])
def test_several_texts_of_one_id_keep_their_links(spark, kind, swapped):
    a, b = ([f"{c}{i}" for i in range(40)] for c in ("ba" if swapped else "ab"))
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(b)), (9, near(b)), (8, near(a)), (6, "a text that is like no other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    found = near_dedup.find_duplicates(df)
    assert {int(r["doc_id"]): int(r["component_id"]) for r in found.collect()} == {5: 5, 6: 6, 7: 5, 8: 5, 9: 5}
    assert sorted(int(r["doc_id"]) for r in near_dedup.keep_one(df, found).collect()) == [5, 6]


def test_shingles_are_those_of_words():
    r = random.Random(9)
    texts = ["".join(r.choice("aB é字 \n\x0b ") for _ in range(r.randint(0, 60))) for _ in range(300)] + [edges.LONG, "x" * 5000 + " a b c d e"]
    for t, s in zip(texts, setsketch.shingle_sets([t.encode() for t in texts]), strict=True):
        assert len(s) == len(plain_set(t)), t


def test_sketches_merge_and_estimate():
    r = np.random.RandomState(4)
    for n, j in ((200, 0.5), (2000, 0.75), (2000, 0.9), (50, 0.75)):
        common = int(2 * n * j / (1 + j))
        x = np.unique(r.randint(0, 2**63, 2 * n - common).astype(np.uint64))
        a, b = np.sort(x[:n]), np.sort(x[n - common :])
        k = setsketch.sketches([a, b, np.unique(x)])
        assert (np.maximum(k[0], k[1]) == k[2]).all()
        estimate = setsketch.likeness(k[:1], k[1:2], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(estimate - common / (2 * n - common)) < 0.09


@pytest.mark.parametrize("edges_", [[(9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (4, 3), (3, 2), (2, 1)], [(1, 2), (3, 4), (2, 4), (10, 11)], [(5, 5)], []])
def test_components(spark, edges_):
    want = {}
    root = {i: i for e in edges_ for i in e}
    for _ in root:
        for a, b in edges_:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: c for i, c in root.items() if c != i}
    got = components.components(spark.createDataFrame(edges_, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == want
