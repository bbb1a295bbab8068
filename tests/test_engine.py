import math

import pytest
from pyspark.sql import functions as F

from glyphlake.engine import IndexerError, MissingDependencyError, VectorStore
from glyphlake.operators import migrate
from glyphlake.operators.migrate import FinalizeCancelled
from glyphlake.settings import EmbedSettings, Settings
from glyphlake.sources.codec import Codec
from glyphlake.sources.embedding import HashEmbedder
from glyphlake.streaming import incremental


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "store"))


def vector(b, i):
    return [math.cos(0.3 * (b * 10 + i) + t) for t in range(8)]


def fill(store):
    for b, n in ((901, 3), (902, 2), (903, 4)):
        for i in range(n):
            store.insert_chunk(b, {"chunk_no": i, "text": f"{b}-{i}", "chapter_path": ["Ch", f"S{i}"]}, [1.0] * 8 if (b, i) == (901, 0) else vector(b, i), "v/Model-GGUF:q8")
        store.upsert_book(b, {901: "EPUB", 902: "PDF", 903: "LRF"}[b], n, "model", 1)
    store.commit()


def test_lifecycle_and_reopen(spark, store):
    fill(store)
    again = VectorStore(spark, store.path)
    top = again.search([1.0] * 8, 5).collect()
    assert (top[0]["book_id"], top[0]["chunk_no"], top[0]["text"], top[0]["fmt"], top[0]["chapter_path"]) == (901, 0, "901-0", "EPUB", ["Ch", "S0"]) and top[0]["score"] > 0.999
    assert again.book_chunks_text(903) == [f"903-{i}" for i in range(4)] and again.search([1.0] * 8, model="nothing").isEmpty()
    again.delete_chunk(902, 1)
    again.delete_chunk(902, 0)
    again.delete_chunk(902, 77)
    assert again.book_is_indexed(902) and again.count_book_chunks(902) == 0 and again.indexed_books().where("book_id = 902").first()["n_chunks"] == 0
    again.clear_book(901)
    assert not again.book_is_indexed(901) and again.count_book_chunks(901) == 0
    again.cleanup_stale_models("other")
    assert again.count_book_chunks(903) == 4 and again.table("chunks").count() == 4
    again.add_chunks(again.table("chunks").withColumn("model", F.lit("old")))
    assert again.count_book_chunks(903) == 8
    again.cleanup_stale_models("model")
    assert again.count_book_chunks(903) == 4
    again.compact()
    assert again.book_chunks_text(903) == [f"903-{i}" for i in range(4)]


def test_registries(store):
    store.enqueue_indexing(906)
    store.enqueue_indexing(907)
    assert store.queued_indexing_book_ids() == [907, 906]
    store.enqueue_indexing(906, 100)
    store.enqueue_indexing(906, 0)
    assert store.queued_indexing_book_ids() == [906, 907]
    store.dequeue_indexing(906)
    assert store.queued_indexing_book_ids() == [907]
    store.set_failed(1, "index", "a")
    store.set_failed(1, "index", "b")
    store.set_failed(1, "attr", "c")
    assert [(e["kind"], e["error"]) for e in store.failed_entries()] == [("attr", "c"), ("index", "b")]
    store.clear_failed(1, "index")
    assert store.failed_book_ids("index") == [] and store.failed_book_ids() == [1]
    store.wipe_failed()
    assert store.failed_entries() == []
    store.set_file_info(901, "EPUB", 123456, 1788528000)
    assert store.get_file_info(901) == {"book_id": 901, "fmt": "EPUB", "size": 123456, "mtime_s": 1788528000} and store.get_file_info(5) is None
    store.set_attrs(1, {"pov": "first", "tags": ["x", "y"], "none": None})
    assert store.get_attrs(1) == {"pov": ["first"], "tags": ["x", "y"], "none": []} and store.attr_book_ids() == [1]
    assert store.attrs_fields().first()["fields"] == ["none", "pov", "tags"]
    store.clear_attrs(1)
    assert store.get_attrs(1) == {}
    store.set_meta("a.b", "1")
    store.set_meta("a.b", "2")
    assert store.get_meta("a.b") == "2" and store.get_meta("c", "d") == "d" and store.meta_keys("a") == ["a.b"]
    assert store.paused
    store.resume()
    assert not store.paused


def test_whole_job_and_reconcile(spark, store, tmp_path):
    kind = "struct<kind:string,pages:array<string>,text:string,error:string>"
    page = "<h1>Title</h1>" + "".join(f"<p>{'lorem ipsum ' * 20}{i}</p>" for i in range(12))
    rows = [(1, "TXT", 10, 5, ("text", None, "word " * 600, None)), (2, "EPUB", 11, 5, ("pages", [page, "", page], None, None)), (3, "TXT", 12, 5, ("text", None, "short", None)), (4, "PDF", 13, 5, ("error", None, None, "locked"))]
    books = spark.createDataFrame(rows, f"book_id long, fmt string, size long, mtime long, extracted {kind}")
    store.enqueue_indexing_many([1, 2, 3, 4])
    settings = Settings(embed=EmbedSettings(model="hash"))
    store.index_books(books, HashEmbedder(256), settings)
    assert {r["book_id"]: r["n_chunks"] > 0 for r in store.indexed_books().collect()} == {1: True, 2: True}
    assert [(e["book_id"], e["error"]) for e in store.failed_entries("index")] == [(3, "too little text"), (4, "locked")]
    assert store.queued_indexing_book_ids() == [] and store.file_info_book_ids() == [1, 2, 3, 4]
    assert store.search(HashEmbedder(256)(["lorem ipsum"])[0], 1).first()["book_id"] == 2
    library = spark.createDataFrame([(2, "EPUB", 11, 5), (3, "TXT", 12, 5), (4, "PDF", 13, 6), (9, "EPUB", 1, 1), (10, None, 1, 1)], "book_id long, fmt string, size long, mtime long")
    actions = {(r["book_id"], r["action"]) for r in store.reconcile(library).collect()}
    assert actions == {(1, "remove"), (4, "index"), (9, "index")}
    assert store.queued_indexing_book_ids() == [9, 4] and not store.book_is_indexed(1) and store.file_info_book_ids() == [2, 3, 4]
    store.resume()
    done = []
    incremental.drain(store, lambda ids: done.append(("index", ids)), lambda ids: done.append(("attr", ids)), 1)
    assert done == [("index", [9]), ("index", [4])]
    snapshots = tmp_path / "snapshots"
    library.selectExpr("1L as snapshot", "*").union(library.where("book_id <> 2").selectExpr("2L", "*")).coalesce(1).write.parquet(str(snapshots))
    incremental.reconcile_stream(spark, str(snapshots), store, str(tmp_path / "cp")).awaitTermination(120)
    assert not store.book_is_indexed(2)


def test_attributes_and_requests(spark, store):
    fill(store)
    settings = Settings(attributes=Settings().attributes[5:6])

    def model(prompt, fields, options):
        if "903-" in prompt:
            raise RuntimeError("down")
        return {"pov": "first person"}

    store.enqueue_indexing(1)
    assert store.extract_books(model, settings).isEmpty()
    store.dequeue_indexing(1)
    store.enqueue_attrs(902)
    store.extract_books(model, settings)
    assert store.get_attrs(901) == store.get_attrs(902) == {"pov": ["first person"]} and store.failed_book_ids("attr") == [903] and store.queued_attrs_book_ids() == []
    store.enqueue_attrs_all()
    assert store.queued_attrs_book_ids() == [903, 902, 901]
    store.extract_books(lambda *a: {"pov": "third"}, settings)
    assert store.failed_book_ids() == [] and store.get_attrs(903) == {"pov": ["third"]}
    library = spark.createDataFrame([(901, "EPUB"), (904, "PDF"), (905, None)], "book_id long, fmt string")
    store.reindex_new_and_failed(library)
    assert store.queued_indexing_book_ids() == [904]
    store.reindex_all(library)
    store.reindex(901)
    assert store.queued_indexing_book_ids() == [901, 904]
    assert store.status(library, settings) == ["Books indexed: 3/3", "Total chunks: 9", "Attributes stored: 3/3 books"]
    found, vector_ = store.ask(" question ", lambda texts: [[1.0] * 8], min_score=-1)
    assert found.first()["book_id"] == 901 and store.search_book(vector_, 901, -1.0).count() == 3
    with pytest.raises(ValueError):
        store.ask("  ", None)


def test_finalize(spark, store):
    fill(store)
    codec = Codec("zlib")
    assert not store.needs_finalize and store.pending_stages(codec) == []
    store.set_meta("codec", Codec("zstd").spec())
    before = sorted(map(str, store.table("chunks").collect()))
    files = lambda: {f.rpartition(".")[0].rpartition(".")[2] for f in store.table("chunks").inputFiles()}
    with pytest.raises(FinalizeCancelled):
        store.finalize_schema(cancel=lambda: True, codec=codec)
    assert files() == {"zstd"} and store.pending_stages(codec) == ["codec"]
    store.finalize_schema(progress=lambda s: 1 / 0, codec=codec)
    assert files() == {"gz"} and sorted(map(str, store.table("chunks").collect())) == before
    assert store.pending_stages(codec) == [] and store.stored_codec() == codec.spec()
    store.insert_chunk(901, {"chunk_no": 9, "text": "new"}, [1.0] * 8, "model")
    store.commit()
    assert files() == {"gz"} and store.count_book_chunks(901) == 4
    with pytest.raises(MissingDependencyError):
        VectorStore(spark, store.path, "something")


def old_store(spark, path, version=0):
    """A store as the oldest version left it, brought up to `version` step by step by hand."""
    import json
    import os
    import struct

    blob = lambda v: bytearray(struct.pack(f"<{len(v)}f", *v))
    tables = {
        "books": spark.createDataFrame([(1, "EPUB", 12.9, 2, "v/M:q", 3), (2, "PDF", 1.0, 1, "v/M:q", 3), (3, "LRF", 2.0, None, None, 3)], "id long, fmt string, indexed_at double, n_chunks int, model string, dim int"),
        "dirty": spark.createDataFrame([(50, "EPUB", "new", 1.0), (50, "EPUB", "changed", 2.0), (51, "PDF", "new", 3.0)], "book_id long, fmt string, reason string, added_at double"),
        "attrs_raw": spark.createDataFrame([(1, '{"pov": "first", "tropes": ["a", "b"]}', "pov,tropes", 1.0)], "book_id long, json string, fields string, updated_at double"),
        "chunks": spark.createDataFrame([(1, 1, 0, "alpha", "Ch > S0", 0, 0, 0, "v/M:q", 3, blob([1.0, 0.0, 0.1])), (2, 1, 1, "beta", "", 1, 1, 7, "v/M:q", 3, blob([0.0, 1.0, 0.3])), (3, 2, 0, "gamma", "", 0, 0, 0, "v/M:q", 3, blob([float("nan"), 1.0, 0.0]))], "id long, book_id long, chunk_no long, text string, chapter_path string, para_start int, para_end int, char_offset int, model string, dim int, vector binary"),
        "meta": spark.createDataFrame([("fileinfo:1", "EPUB|717102|1598092103.694143"), ("failed", '{"7": {"error": "boom"}}'), ("attr_failed", '{"1": {"error": "no answer"}}'), ("paused", "0")], "key string, value string"),
    }
    os.makedirs(path)
    for v in range(1, version + 1):
        tables = migrate.STEPS[v](tables)
    named = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}-old")
        named[name] = [["rows", f"{name}-old"]] if name == "chunks" and version >= 2 else f"{name}-old"
    with open(f"{path}/manifest.json", "w") as out:
        json.dump({"version": version, "tables": named}, out)
    return VectorStore(spark, path)


@pytest.mark.parametrize("version", [0, 1, 2, 3, 4])
def test_older_stores_are_brought_up(spark, tmp_path, version):
    store = old_store(spark, str(tmp_path / "old"), version)
    assert store.needs_finalize and store.pending_stages() == ["schema"] and store.search([1.0, 0.0, 0.0]).isEmpty()
    with pytest.raises(IndexerError):
        store.enqueue_indexing(5)
    steps = iter([False, False, True])
    if version < 3:
        with pytest.raises(FinalizeCancelled):
            store.finalize_schema(cancel=lambda: next(steps))
        assert store.needs_finalize
    seen = []
    store.finalize_schema(progress=seen.append)
    assert seen == ["schema"] and not store.needs_finalize
    again = VectorStore(spark, store.path)
    top = again.search([1.0, 0.0, 0.1], 5).collect()
    assert [(r["book_id"], r["chunk_no"], r["text"], r["fmt"], r["chapter_path"]) for r in top] == [(1, 0, "alpha", "EPUB", ["Ch", "S0"])] and top[0]["score"] > 0.99
    assert {r["book_id"] for r in again.indexed_books().collect()} == {1, 3} and {r["model"] for r in again.table("chunks").collect()} == {"m"}
    assert again.queued_indexing_book_ids() == [51, 50, 2]  # the book with a broken vector is read anew
    assert again.get_file_info(1) == {"book_id": 1, "fmt": "EPUB", "size": 717102, "mtime_s": 1598092103}
    assert [(e["book_id"], e["kind"], e["error"]) for e in again.failed_entries()] == [(1, "attr", "no answer"), (7, "index", "boom")]
    assert again.get_attrs(1) == {"pov": ["first"], "tropes": ["a", "b"]} and again.meta_keys() == ["paused"] and not again.paused
    again.enqueue_indexing(5, 100)
    assert again.queued_indexing_book_ids()[0] == 5


def test_a_step_that_loses_something_publishes_nothing(spark, tmp_path, monkeypatch):
    store = old_store(spark, str(tmp_path / "old"), 1)
    monkeypatch.setitem(migrate.STEPS, 2, lambda t: migrate.by_model_step(t) | {"chunks": migrate.by_model_step(t)["chunks"].where("chunk_no = 0")})
    with pytest.raises(IndexerError):
        store.finalize_schema()
    monkeypatch.undo()
    assert store.needs_finalize
    store.finalize_schema()
    assert store.count_book_chunks(1) == 2


def test_readers_outlive_changes(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    fill(store)
    books, top = store.table("books"), store.search([1.0] * 8, 3)
    store.delete_chunk(901, 0)
    store.clear_book(902)
    store.compact()
    assert books.count() == 3 and top.count() == 3 and store.table("books").count() == 2
    short = VectorStore(spark, store.path, grace=0.0)
    short.set_meta("a", "b")
    short.set_meta("a", "c")
    import os

    named = short._read("manifest.json")
    assert len([f for f in os.listdir(store.path) if os.path.isdir(f"{store.path}/{f}")]) == len(named["tables"]) and named["retired"] == []


def test_migrations(spark):
    meta = spark.createDataFrame([("fileinfo:1", "EPUB|717102|1598092103.694143"), ("fileinfo:x", "a|1|1"), ("failed", '{"3": {"error": "boom"}}'), ("other", "v")], "key string, value string")
    tables = {
        "books": spark.createDataFrame([(1, "EPUB", 12.9, 2, "a/M:q", 8), (2, "PDF", 1.0, None, None, 8)], "id long, fmt string, indexed_at double, n_chunks int, model string, dim int"),
        "dirty": spark.createDataFrame([(50, "new"), (50, "changed"), (51, "new")], "book_id long, reason string"),
        "attrs_raw": spark.createDataFrame([(1, '{"a": "x", "b": ["y", "z"]}'), (2, "broken")], "book_id long, json string"),
        "meta": meta,
    }
    out = migrate.v1_registries(tables)
    assert [(r["book_id"], r["indexed_at"], r["n_chunks"]) for r in out["books"].orderBy("book_id").collect()] == [(1, 12, 2), (2, 1, 0)]
    assert [tuple(r) for r in out["file_info"].collect()] == [(1, "EPUB", 717102, 1598092103)]
    assert out["attrs"].where("book_id = 1").first()["values"] == {"a": ["x"], "b": ["y", "z"]}
    assert out["queue"].count() == 2 and out["meta"].count() == 2
    chunks = spark.createDataFrame([(1, 0, "t", ["p"], [0.1, 0.2], "A/M-gguf"), (2, 0, "t", [], [float("nan"), 1.0], None), (2, 1, "t", [], [1.0, 1.0], None)], "book_id long, chunk_no long, text string, chapter_path array<string>, vector array<float>, model string")
    split = migrate.v2_by_model(chunks)
    assert {r["model"] for r in split.collect()} == {"m", "model"} and migrate.verified(chunks, split, ["book_id", "chunk_no"])
    kept, queued = migrate.v3_half_precision(split)
    assert [r["book_id"] for r in kept.collect()] == [1] and [r["book_id"] for r in queued.collect()] == [2]
    assert not migrate.verified(split, kept, ["book_id"])
    assert [tuple(r) for r in migrate.v4_failures(meta, "failed", "index").collect()] == [(3, "index", "boom")]
    assert migrate.v5_queue(tables["dirty"]).agg(F.sum("priority"), F.count("*")).first() == (0, 2)
    assert {r["book_id"] for r in migrate.transfer_rest(split, split.where("chunk_no = 0")).collect()} == {2}
