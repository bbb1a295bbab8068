"""The index of cells and codes gives what a full search gives, through adding, dropping and merging."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import cells, search


def table(spark, n=900, width=24, seed=3, clusters=12):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((clusters, width))
    x = middle[rng.integers(0, clusters, n)] + 0.35 * rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[6]  # ties
    rows = [(i // 3, i % 3, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    return spark.createDataFrame([*rows, (10_000, 0, None), (10_001, 0, [1.0, 2.0])], "book_id long, chunk_no int, vector array<float>")


def queries_of(chunks):
    return chunks.where("chunk_no = 0 and book_id % 20 = 0 and size(vector) > 2").select(F.col("book_id").alias("query_id"), "vector")


def same(index, chunks, queries, **more):
    got = sorted(map(tuple, index.search_many(chunks, queries, **more).collect()))
    want = sorted(map(tuple, search.search_many(chunks.where("size(vector) > 2"), queries, **more).collect()))
    assert [(q, b, c) for q, b, c, _ in got] == [(q, b, c) for q, b, c, _ in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)
    return want


def test_exact_through_add_drop_and_merge(spark, tmp_path):
    chunks = table(spark)
    first, later = chunks.where("book_id < 240 or book_id >= 10000"), chunks.where("book_id >= 240 and book_id < 10000")
    index = cells.CellIndex(spark, str(tmp_path / "index"), cells=16)
    index.build(first)
    queries = queries_of(chunks)
    assert same(index, first, queries, limit=7)
    assert index.add(later.where("book_id < 260")) is False
    assert index.add(later.where("book_id >= 260")) is True
    assert same(index, chunks, queries, limit=7)
    index.drop(spark.createDataFrame([(b,) for b in range(0, 100, 3)], "book_id long"))
    index.drop(spark.createDataFrame([(1, 0), (250, 2)], "book_id long, chunk_no int"))
    left = chunks.where("not (book_id < 100 and book_id % 3 = 0) and not (book_id = 1 and chunk_no = 0) and not (book_id = 250 and chunk_no = 2)")
    want = same(index, left, queries, limit=7)
    index.add(chunks.where("book_id = 3"))  # dropped, and back again
    back = left.union(chunks.where("book_id = 3"))
    assert same(index, back, queries, limit=7)
    index.merge(back)
    assert [e[1].split()[0] for e in index.entries()] == ["centres", "kinds", "part"] and same(index, back, queries, limit=7)
    fresh = cells.CellIndex(spark, str(tmp_path / "fresh"), cells=16)
    fresh.build(left)
    assert same(fresh, left, queries, limit=7) == want


@pytest.mark.parametrize("min_score", [0.0, 0.9])
def test_limits_and_blocks_of_queries(spark, tmp_path, min_score):
    chunks = table(spark, 300)
    index = cells.CellIndex(spark, str(tmp_path / "index"), cells=8)
    index.build(chunks)
    for limit in (1, 1000):
        same(index, chunks, queries_of(chunks), limit=limit, min_score=min_score, query_bytes=300)
    assert index.search_many(chunks, queries_of(chunks).limit(0)).count() == 0


def test_cells_that_cannot_matter_are_not_read(spark, tmp_path):
    chunks = table(spark)
    index = cells.CellIndex(spark, str(tmp_path / "index"), cells=12)
    index.build(chunks)
    n, radius = index.cell_sizes()
    centres = index.centres()
    query = np.array([search.unit(chunks.first()["vector"])])
    everything = cells.lowest_scores(index.rows(), centres, query, 5)
    wanted = cells.candidates(index.rows(), centres, query, everything).count()
    assert n.sum() == 900 and wanted < 0.2 * 900
    assert re.search(r"PartitionFilters: \[[^\]]*cell", index.rows([1, 2])._jdf.queryExecution().executedPlan().toString())
    coded = {(r["book_id"], r["chunk_no"]): r for r in index.rows().collect()}
    for book, number, v in ((b, c, v) for b, c, v in chunks.where("size(vector) = 24").limit(50).collect()):
        r = coded[book, number]
        assert np.linalg.norm(np.array(v) - centres[r["cell"]]) <= radius[r["cell"]] + 1e-9


def test_probes_find_most(spark, tmp_path):
    chunks = table(spark)
    index = cells.CellIndex(spark, str(tmp_path / "index"), cells=12)
    index.build(chunks)
    queries = queries_of(chunks)
    exact = {tuple(r)[:3] for r in search.search_many(chunks.where("size(vector) > 2"), queries, 10).collect()}
    got = {tuple(r)[:3] for r in index.search_many(chunks, queries, 10, probes=3).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_scores_are_worked_out_in_bounded_blocks(monkeypatch):
    """However many queries there are, no matrix of rows by queries is larger than WORK_BYTES."""
    rng, n, width = np.random.default_rng(5), 3000, 24
    monkeypatch.setattr(cells, "WORK_BYTES", 1 << 16)
    centres, queries = rng.standard_normal((4, width)), rng.standard_normal((900, width))
    x = rng.standard_normal((n, width))
    cell = (np.arange(n) % 4).astype(np.int32)
    left = x - centres[cell]
    scale = np.abs(left).max(1) / 7
    code = np.rint(left / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(left - code * scale[:, None], axis=1)
    batch = pa.RecordBatch.from_arrays([pa.array(cell), pa.array([p.tobytes() for p in cells._packed(code)], pa.binary()), pa.array(scale), pa.array(rest)], names=["cell", "code", "scale", "rest"])
    seen = 0
    for piece in cells._pieces([batch], width):
        at_row = seen
        for at, low, high in cells.bounds(piece, centres, queries):
            assert max(low.nbytes, high.nbytes) <= cells.WORK_BYTES
            exact = x[at_row : at_row + piece.num_rows] @ queries[at].T
            assert (low <= exact).all() and (exact <= high).all()
        seen += piece.num_rows
    assert seen == n


def test_copies_and_ties_hand_on_few_rows(spark):
    """Of equal vectors of a book one is scored for each query; two books that tie beyond the limit both stay."""
    v = [0.6, 0.8]
    rows = [(1, c, v) for c in range(200)] + [(2, c, v) for c in range(50)] + [(3, 0, [1.0, 0.0]), (4, 0, [float("nan"), 1.0])]
    chunks = spark.createDataFrame(rows, "book_id long, chunk_no int, vector array<float>").coalesce(1)
    queries = np.array([v, [1.0, 0.0], [-0.6, -0.8]])
    got = cells.best_chunks(chunks, queries, np.full(3, -np.inf), 1).collect()
    assert {(r["q"], r["book_id"]) for r in got} == {(0, 1), (0, 2), (1, 3), (2, 3)}
    assert len(got) < 150 and all((q, b, 0) in {tuple(r) for r in got} for q, b in ((0, 1), (0, 2), (1, 3)))
