from glyphlake import schemas
from glyphlake.operators import registry


def made(spark, **rows):
    tables = {n: schemas.empty(spark, n) for n in schemas.TABLES if n not in ("meta", "chunks")}
    return tables | {n: spark.createDataFrame(r, schemas.TABLES[n]) for n, r in rows.items()}


def library(spark, rows):
    return spark.createDataFrame(rows, "book_id long, fmt string, size string, mtime double")


def actions(spark, lib, tables):
    return {(r["book_id"], r["action"]) for r in registry.reconcile(library(spark, lib), tables).collect()}


def test_reconcile_cases(spark):
    tables = made(
        spark,
        books=[(1, "EPUB", 0, 3, "m"), (2, "EPUB", 0, 3, "m"), (3, "EPUB", 0, 3, "m"), (4, "EPUB", 0, 3, "m"), (20, "EPUB", 0, 1, "m")],
        file_info=[(1, "EPUB", 10, 5), (2, "EPUB", 10, 5), (5, "EPUB", 10, 5), (6, "EPUB", 10, 5), (21, "EPUB", 1, 1)],
        failed=[(5, "index", "e"), (6, "index", "e"), (7, "index", "e"), (22, "attr", "e")],
        queue_index=[(23, 0)], queue_attrs=[(24, 100)], attrs=[(25, {"a": ["x"]})],
    )
    lib = [
        (1, "EPUB", "10", 5.9),  # unchanged: seconds are cut off
        (2, "EPUB", "11", 5.0),  # another size
        (3, "EPUB", None, None),  # nothing recorded, same format
        (4, "PDF", "1", 1.0),  # nothing recorded, other format
        (5, "EPUB", "10", 5.0),  # failed and unchanged
        (6, "EPUB", "10", 6.0),  # failed and changed
        (7, "EPUB", "10", 5.0),  # failed without file info
        (8, "EPUB", "x", None),  # new
        (9, None, None, None),  # nothing to read
    ]
    assert actions(spark, lib, tables) == {(2, "index"), (4, "index"), (6, "index"), (7, "index"), (8, "index")} | {(i, "remove") for i in (20, 21, 22, 23, 24, 25)}
    after = registry.apply_reconcile(registry.reconcile(library(spark, lib), tables), tables)
    assert [r["book_id"] for r in registry.queue_order(after["queue_index"]).collect()] == [8, 7, 6, 4, 2]
    assert after["queue_attrs"].isEmpty() and after["attrs"].isEmpty() and after["books"].count() == 4 and after["failed"].count() == 3
    assert actions(spark, lib, {**tables, **{n: after[n] for n in ("books", "file_info", "failed", "attrs", "queue_attrs", "queue_index")}}) == {(2, "index"), (4, "index"), (6, "index"), (7, "index"), (8, "index")}


def test_changed_file_without_recorded_size(spark):
    tables = made(spark, books=[(1, "EPUB", 0, 3, "m")], file_info=[(1, "EPUB", 10, 5)])
    assert actions(spark, [(1, "EPUB", None, 5.0)], tables) == {(1, "index")}


def test_empty_tables(spark):
    tables = made(spark)
    assert actions(spark, [(1, "EPUB", "1", 1.0)], tables) == {(1, "index")}
    assert registry.vanished(library(spark, [(1, "EPUB", "1", 1.0)]), tables).isEmpty()
    row = registry.status(library(spark, [(1, "EPUB", "1", 1.0)]), tables["books"], tables["books"].select("book_id"), tables["failed"]).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0) and registry.status_lines(row)[0] == "Books indexed: 0/1"


def test_orders(spark):
    forced = spark.createDataFrame([(3, 5), (9, 100), (4, 100)], "book_id long, priority int")
    pending = spark.createDataFrame([(1,), (9,), (7,)], "book_id long")
    got = registry.attribute_order(pending, forced)
    assert [r["book_id"] for r in got.collect()] == [9, 4, 3, 7, 1]
    shown = spark.createDataFrame([("b", 0.2, 0), ("A", -0.5, 1), ("B", 0.1, 2)], "title string, score double, place int")
    assert [r["place"] for r in registry.results_order(shown, "title", before="place").collect()] == [1, 0, 2]
    assert [r["place"] for r in registry.results_order(shown, "score", True).collect()] == [0, 2, 1]


def test_pending_and_stale(spark):
    books = spark.createDataFrame([(i, "EPUB", 0, n, m) for i, n, m in ((1, 1, "a"), (2, 0, "b"), (3, 2, "a"), (4, 1, "a"))], schemas.TABLES["books"])
    attrs = spark.createDataFrame([(1, {"y": [], "x": ["1"]}), (3, {"x": ["1"]})], schemas.TABLES["attrs"])
    failed = spark.createDataFrame([(4, "attr", "e"), (3, "index", "e")], schemas.TABLES["failed"])
    assert [r["book_id"] for r in registry.pending_attributes(books, attrs, ["x", "y"]).orderBy("book_id").collect()] == [3, 4]
    assert [r["book_id"] for r in registry.pending_attributes(books, attrs, ["x", "y"], failed).collect()] == [3]
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    assert {r["model"] for r in registry.stale_models(models, books).collect()} == {"b", "c"}
    assert {r["model"] for r in registry.stale_models(models, books, "c").collect()} == {"b"}
    counted = registry.recount(books, spark.createDataFrame([(1,), (1,), (2,)], "book_id long"))
    assert {r["book_id"]: r["n_chunks"] for r in counted.collect()} == {1: 2, 2: 1, 3: 0, 4: 0}


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "index", "a"), (1, "attr", "b"), (2, "index", "c")], schemas.TABLES["failed"])
    new = spark.createDataFrame([(1, "index", "z"), (3, "attr", "y")], schemas.TABLES["failed"])
    assert {tuple(r) for r in registry.upsert(old, new, ["book_id", "kind"]).collect()} == {(1, "index", "z"), (1, "attr", "b"), (2, "index", "c"), (3, "attr", "y")}
    assert {r["book_id"] for r in registry.remove(old, new.select("book_id")).collect()} == {2}


def test_plans_read_and_shuffle_no_more_than_needed(spark, sf_dir):
    from glyphlake.plans import catalogue

    plan = lambda name: catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("token_estimate")
    for name in ("token_estimate", "snippet", "search_phrase", "normalize_value", "pick_format", "chunk_pack", "html_units"):
        assert "Exchange" not in plan(name), name
    for name in ("reconcile_actions", "pending_attributes", "new_and_failed", "registry_join"):
        assert "CartesianProduct" not in plan(name) and "NestedLoop" not in plan(name), name
