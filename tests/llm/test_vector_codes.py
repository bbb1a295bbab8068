"""Vector codes against SQL on the tables and against plain Python on small ones."""

import hashlib
import math

import pytest

import compare
from edges import rows
from glyphlake.llm import queries, vector_codes


def plain(vectors, parts, entries, rounds):
    """(id, label, code, error) and the codebooks, by loops."""
    kept = sorted([(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in vectors if v and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        fresh = [list(b) for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for _, v, _ in kept if best(p, cut(v, p)) == e]
                if own:
                    fresh[p][e] = [math.floor(sum(c) / len(own)) for c in zip(*own, strict=True)]
        books = fresh
    out = []
    for i, v, lab in kept:
        codes = [best(p, cut(v, p)) for p in range(parts)]
        out.append((i, lab, "".join(f"{c:02x}" for c in codes), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(codes))))
    return out, books


def test_same_as_sql(spark, sf_dir):
    assert compare.same(queries.op12_vector_codes(spark, sf_dir), queries.ORACLES["op12_vector_codes"], sf_dir)[2]


VECTORS = [(5, [0.1, -0.2, 0.3, 0.4], 1), (3, [0.1, -0.2, 0.9, -1.0], 1), (3, [0.5, 0.5, 0.5, 0.5], None), (9, None, 1), (8, [0.1, None, 0.0, 0.0], 2), (7, [float("nan"), 0.0, 0.0, 0.0], 2), (6, [float("inf"), 0.0, 0.0, 0.0], 2), (None, [-0.001, 0.001, 0.0, 0.3], None), (11, [0.1, -0.2, 0.31, 0.4], 2)] + [(20 + i, [0.1, -0.2, 0.3, 0.4], 3) for i in range(40)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(2, 3, 2), (4, 2, 1), (1, 64, 2), (2, 1, 3), (2, 3, 0)])
def test_small_tables(spark, parts, entries, rounds):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as `row`", "'x' as code", "0 as error", "'k' as key", "1 as weight")
    got, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, expected = plain([tuple(r) for r in spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").collect()], parts, entries, rounds)
    assert books.tolist() == expected
    by_label = {}
    for _, lab, _, error in want:
        by_label[lab] = by_label.get(lab, 0) + error
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, c, e, by_label[lab]) for i, lab, c, e in want), key=repr)


def test_hot_parts_are_joined_apart(spark):
    many = [(i, [0.25] * 4 if i % 3 else [i / 1000, 0.0, 0.25, 0.25], 7) for i in range(900)]
    got, _ = vector_codes.compress(spark.createDataFrame(many, "vec_id long, embedding array<float>, label int"), parts=2, entries=4)
    want, _ = plain(many, 2, 4, 2)
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == sorted((i, c, e) for i, _, c, e in want)


def test_other_widths_and_large_numbers(spark):
    data = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (3, [1.0, 2.0, 3.0], 1), (4, [], 1), (5, [1e38, -1e38], 1)]
    got, books = vector_codes.compress(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), parts=2, entries=2, rounds=0)
    assert sorted(r.vec_id for r in got.collect()) == [1, 5]
    assert books.tolist() == [[[256], [1 << 29]], [[512], [-(1 << 29)]]]
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), entries=257)


def test_empty(spark):
    none = rows(spark, [], "vec_id", "label").selectExpr("*", "cast(null as array<float>) as embedding")
    got = vector_codes.report(*vector_codes.compress(none))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_digest_of_the_codebooks(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int")
    got, books = vector_codes.compress(df, parts=2, entries=3)
    text = ",".join(str(x) for part in books.tolist() for entry in part for x in entry)
    assert {r.codebooks_sha256 for r in vector_codes.report(got, books).collect()} == {hashlib.sha256(text.encode()).hexdigest()}
