"""A store of books, chunks, queues and attributes over Parquet, with the calls an application makes.

Every registry is a base with changes on top (`operators.keyed`), chunks are a list of segments (rows added, rows dropped),
partitioned by model. A manifest names them and is replaced in one rename, so a reader sees either all of a change or nothing, and an
interrupted one leaves the old state. What a change replaces is kept for a while (GRACE), so that tables and results
handed out before it can still be read. A change to a registry writes the rows it changes, one to chunks what it adds and which are
dropped; the rest of the table isn't touched until changes are merged or `compact` runs. A store of an older version shows empty tables until `finalize_schema` has
brought it up. The store has one writer; operators on DataFrames (`operators`) do the work, and bulk work should use them
directly."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake import schemas
from glyphlake.functions import values, vectors
from glyphlake.operators import keyed, migrate, packing, registry, search
from glyphlake.operators.migrate import FinalizeCancelled
from glyphlake.settings import MAX_RESULTS, MIN_EXTRACTED_CHARS, PRIORITY_DEFAULT, PRIORITY_PER_BOOK, SCHEMA_VERSION, Settings
from glyphlake.sources.codec import Codec, resolve
from glyphlake.sources.embedding import Embed, embedded


#: Chunk segments that a store keeps before it joins them; what a segment of dropped chunks holds.
SEGMENTS = 32
DROPS = "book_id long, chunk_no int"
#: Seconds for which replaced folders stay readable.
GRACE = 3600.0
#: How Parquet compresses the chunks of a store with this codec.
COMPRESSION = {"zlib": "gzip", "zstd": "zstd"}


class IndexerError(Exception):
    pass


class MissingDependencyError(Exception):
    """A backend was asked for that this engine lacks."""


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, backend: str | None = None, grace: float = GRACE):
        if backend not in (None, "parquet", "sqlite", "auto"):
            raise MissingDependencyError(backend)
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._buffer: list[tuple] = []
        self.grace = grace
        if self._read("manifest.json") is None:
            self._publish({"version": SCHEMA_VERSION, "tables": {}})

    # files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self, name: str) -> dict | None:
        if not self._fs.exists(self._at(name)):
            return None
        lines = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return json.loads(lines[0][0])

    def _publish(self, manifest: dict) -> None:
        new = self._at(f"manifest-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        kinds[0] = options.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("x").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(new), context.makeQualified(self._at("manifest.json")), kinds)

    def table(self, name: str) -> DataFrame:
        manifest = self._read("manifest.json")
        entry = manifest["tables"].get(name) if manifest["version"] == SCHEMA_VERSION else None
        if name == "chunks":
            return self._chunks(entry or [])
        return self._state(name, entry)

    def _state(self, name: str, entry: dict | str | None) -> DataFrame:
        """A registry as its entry says: {base: [folder, bytes] or null, changes: [[folder, bytes, level], ...]}, or one folder."""
        kind = schemas.empty(self.spark, name)
        entry = entry if isinstance(entry, dict) else {"base": [entry, 0] if entry else None, "changes": []}
        base = self.spark.read.schema(kind.schema).parquet(f"{self.path}/{entry['base'][0]}").select(kind.columns) if entry["base"] else kind
        return keyed.merged(base, self._changes(name, entry["changes"]), schemas.KEYS[name], name in schemas.HIGHEST) if entry["changes"] else base

    def _changes(self, name: str, changes: Sequence[Sequence]) -> DataFrame:
        kind = keyed.change_schema(schemas.empty(self.spark, name).schema)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{c[0]}" for c in changes))

    @staticmethod
    def _folders(entry: dict | list | str | None) -> list[str]:
        """All folders that a table's entry in the manifest names."""
        if isinstance(entry, dict):
            return [x[0] for x in ([entry["base"]] if entry["base"] else []) + entry["changes"]]
        return [f for _, f in entry] if isinstance(entry, list) else [entry] if entry else []

    def _sized(self, folder: str) -> list:
        return [folder, self._fs.getContentSummary(self._at(folder)).getLength()]

    def _changed(self, name: str, entry: dict | str | None, seq: int, rows: DataFrame | None, gone: DataFrame | None) -> tuple[dict, list[str]]:
        """The entry of a registry from which these keys are taken and in which these rows are then put, and folders that it
        no longer names. Runs of changes are merged as they come due, the base is written again once changes are large beside it."""
        kind, keys, highest = schemas.empty(self.spark, name), schemas.KEYS[name], name in schemas.HIGHEST
        old = entry if isinstance(entry, dict) else {"base": self._sized(entry) if entry else None, "changes": []}
        made = [] if gone is None else [keyed.drops(gone, kind.schema, keys, seq)]
        if rows is not None:
            made.append((keyed.raises if highest else keyed.puts)(rows.select(kind.columns), seq + 1))
        both = made[0] if len(made) == 1 else made[0].unionByName(made[1])
        changes = [*old["changes"], [*self._sized(self._write(name, keyed.folded(both, keys, highest))), 0]]
        seen = {*self._folders(old), changes[-1][0]}
        while run := keyed.run_due([c[2] for c in changes], keyed.FAN):
            one = self._write(name, keyed.folded(self._changes(name, changes[-run:]), keys, highest))
            changes = [*changes[:-run], [*self._sized(one), changes[-1][2] + 1]]
            seen.add(one)
        new = {"base": old["base"], "changes": changes}
        if keyed.base_due(old["base"][1] if old["base"] else 0, sum(c[1] for c in changes), keyed.LEAST):
            new = {"base": self._sized(self._write(name, keyed.clustered(self._state(name, new), keys))), "changes": []}
        return new, sorted(seen - set(self._folders(new)))

    def _chunks(self, segments: list) -> DataFrame:
        """Chunks are segments in order: rows that were added, and what was dropped from those before."""
        kind = schemas.empty(self.spark, "chunks")
        out = None
        for what, folder in segments:
            if what == "rows":
                part = self.spark.read.schema(kind.schema).parquet(f"{self.path}/{folder}").select(kind.columns)
                out = part if out is None else out.unionByName(part)
            elif out is not None:
                gone = self.spark.read.schema(DROPS).parquet(f"{self.path}/{folder}")
                out = out.join(gone.where("chunk_no is null").select("book_id"), "book_id", "left_anti").join(gone.where("chunk_no is not null"), ["book_id", "chunk_no"], "left_anti").select(kind.columns)
        return kind if out is None else out

    def _write(self, name: str, df: DataFrame, codec: Codec | None = None) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        if name == "chunks" and codec is None:
            codec = resolve(self.stored_codec(), Codec("zstd"))[0]
        writer = df.write.option("compression", COMPRESSION[codec.name] if codec else "zstd")
        (writer.partitionBy("model") if name == "chunks" else writer).parquet(f"{self.path}/{folder}")
        return folder

    def _stage(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """df written once, to be read by several parts of a job, and the folder it is in."""
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}"), folder

    def _replace(self, manifest: dict, old: Iterable[str | None]) -> None:
        """Publishes a manifest that no longer names these folders; those replaced longer ago than the grace go."""
        now = time.time()
        retired = [*manifest.get("retired", []), *([f, now] for f in old if f)]
        manifest["retired"] = [x for x in retired if now - x[1] < self.grace]
        self._publish(manifest)
        for folder, at in retired:
            if now - at >= self.grace:
                self._fs.delete(self._at(folder), True)

    def publish(self, added: DataFrame | None = None, dropped: DataFrame | None = None, changes: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None, **tables: DataFrame) -> None:
        """New versions of these tables, changes to others (by name: rows put, or added to a queue, and before that keys
        taken away), chunks dropped (book_id, chunk_no; a null number means the whole book) and then added, published
        together. Neither chunks nor registries are rewritten for a change: it costs what it adds."""
        manifest = self._read("manifest.json")
        if manifest["version"] != SCHEMA_VERSION:
            raise IndexerError("this store is of an older version: run finalize_schema first")
        segments = list(manifest["tables"].get("chunks") or [])
        old = []
        if dropped is not None and segments:
            segments.append(["drop", self._write("dropped", dropped.select("book_id", F.col("chunk_no").cast("int").alias("chunk_no")))])
        if added is not None:
            segments.append(["rows", self._write("chunks", added.select(schemas.empty(self.spark, "chunks").columns))])
        manifest["tables"]["chunks"] = segments
        for name, (rows, gone) in (changes or {}).items():
            entry, seq = manifest["tables"].get(name), manifest.get("seq", 0)
            manifest["tables"][name], spent = self._changed(name, entry, seq, rows, gone)
            manifest["seq"] = seq + 2
            old += spent
        for name, df in tables.items():
            old += self._folders(manifest["tables"].get(name))
            manifest["tables"][name] = {"base": self._sized(self._write(name, df.select(schemas.empty(self.spark, name).columns))), "changes": []}
        self._replace(manifest, old)
        if len(segments) > SEGMENTS:
            self.compact()

    def compact(self, codec: Codec | None = None) -> None:
        """Writes the chunks that are left as one segment, or all of them with another codec, which is published with them: a
        store is converted whole or not at all."""
        manifest = self._read("manifest.json")
        old = manifest["tables"].get("chunks") or []
        if len(old) > 1 or old and codec:
            manifest["tables"]["chunks"] = [["rows", self._write("chunks", self._chunks(old), codec)]]
        elif not codec:
            return
        gone = [folder for _, folder in old]
        if codec:
            entry, seq = manifest["tables"].get("meta"), manifest.get("seq", 0)
            manifest["tables"]["meta"], spent = self._changed("meta", entry, seq, self._rows("meta", [("codec", codec.spec())]), None)
            manifest["seq"] = seq + 2
            gone += spent
        self._replace(manifest, gone)

    def _rows(self, name: str, rows: Iterable[tuple]) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schemas.TABLES[name])

    def _rows_of(self, kind: str, rows: Iterable[tuple]) -> DataFrame:
        return self.spark.createDataFrame(list(rows), kind)

    def _upsert(self, name: str, rows: Iterable[tuple]) -> None:
        self.publish(changes={name: (self._rows(name, rows).coalesce(1), None)})

    def _drop(self, name: str, **keys) -> None:
        """Takes away the row under these keys, or, if they aren't all of the table's, those rows that have them."""
        if list(keys) == schemas.KEYS[name]:
            gone = self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in keys.items()))
        else:
            gone = self.table(name)
            for k, v in keys.items():
                gone = gone.where(F.col(k) == v)
        self.publish(changes={name: (None, gone)})

    def _keys_of(self, name: str, books: DataFrame) -> DataFrame:
        """The keys of what a registry holds of these books."""
        return books.select("book_id") if schemas.KEYS[name] == ["book_id"] else self.table(name).join(books.select("book_id"), "book_id", "left_semi").select(schemas.KEYS[name])

    def close(self) -> None:
        self.commit()

    # key and value

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row["value"] if row else default

    def set_meta(self, key: str, value: str) -> None:
        self._upsert("meta", [(key, value)])

    def delete_meta(self, key: str) -> None:
        self._drop("meta", key=key)

    def meta_keys(self, prefix: str = "") -> list[str]:
        return [r["key"] for r in self.table("meta").where(F.startswith("key", F.lit(prefix))).orderBy("key").collect()]

    @property
    def paused(self) -> bool:
        """Kept over sessions; a store that doesn't say is paused."""
        return self.get_meta("paused", "1") != "0"

    def pause(self) -> None:
        self.set_meta("paused", "1")

    def resume(self) -> None:
        self.set_meta("paused", "0")

    # queues

    def _enqueue(self, queue: str, ids: Iterable[int], priority: int) -> None:
        self.publish(changes={queue: (self._rows(queue, [(i, priority) for i in ids]).coalesce(1), None)})

    def enqueue_indexing(self, book_id: int, priority: int = PRIORITY_DEFAULT) -> None:
        self._enqueue("queue_index", [book_id], priority)

    def enqueue_indexing_many(self, ids: Iterable[int], priority: int = PRIORITY_DEFAULT) -> None:
        self._enqueue("queue_index", ids, priority)

    def queued_indexing_book_ids(self) -> list[int]:
        return [r["book_id"] for r in registry.queue_order(self.table("queue_index")).collect()]

    def next_indexing(self, most: int) -> list[int]:
        return [r["book_id"] for r in registry.queue_order(self.table("queue_index")).limit(most).collect()]

    def next_attrs(self, most: int) -> list[int]:
        return [r["book_id"] for r in registry.queue_order(self.table("queue_attrs")).limit(most).collect()]

    def dequeue_many(self, queue: str, ids: Iterable[int]) -> None:
        """These books leave 'queue_index' or 'queue_attrs' in one change."""
        self.publish(changes={queue: (None, self._rows(queue, [(i, 0) for i in ids]).coalesce(1))})

    def dequeue_indexing(self, book_id: int) -> None:
        self._drop("queue_index", book_id=book_id)

    def enqueue_attrs(self, book_id: int, priority: int = PRIORITY_PER_BOOK) -> None:
        self._enqueue("queue_attrs", [book_id], priority)

    def enqueue_attrs_all(self, priority: int = PRIORITY_DEFAULT) -> None:
        books = self.table("books").where("n_chunks > 0").select("book_id", F.lit(priority).alias("priority"))
        self.publish(changes={"queue_attrs": (books, None)})

    def queued_attrs_book_ids(self) -> list[int]:
        return [r["book_id"] for r in registry.queue_order(self.table("queue_attrs")).collect()]

    def dequeue_attrs(self, book_id: int) -> None:
        self._drop("queue_attrs", book_id=book_id)

    # registry

    def indexed_books(self) -> DataFrame:
        return self.table("books")

    def book_is_indexed(self, book_id: int) -> bool:
        return not self.table("books").where(F.col("book_id") == book_id).isEmpty()

    def upsert_book(self, book_id: int, fmt: str, n_chunks: int, model: str, indexed_at: int | None = None) -> None:
        self._upsert("books", [(book_id, fmt, int(time.time()) if indexed_at is None else indexed_at, n_chunks, model)])

    def clear_book(self, book_id: int) -> None:
        one = self._rows("queue_index", [(book_id, 0)])
        self.publish(dropped=self._rows_of("book_id long, chunk_no int", [(book_id, None)]), changes={"books": (None, one)})

    def get_file_info(self, book_id: int) -> dict | None:
        row = self.table("file_info").where(F.col("book_id") == book_id).first()
        return row.asDict() if row else None

    def set_file_info(self, book_id: int, fmt: str, size: int, mtime_s: int) -> None:
        self._upsert("file_info", [(book_id, fmt, size, mtime_s)])

    def clear_file_info(self, book_id: int) -> None:
        self._drop("file_info", book_id=book_id)

    def file_info_book_ids(self) -> list[int]:
        return [r["book_id"] for r in self.table("file_info").select("book_id").orderBy("book_id").collect()]

    def set_failed(self, book_id: int, kind: str, error: str) -> None:
        if kind not in ("index", "attr"):
            raise ValueError(kind)
        self._upsert("failed", [(book_id, kind, error)])

    def clear_failed(self, book_id: int, kind: str | None = None) -> None:
        self._drop("failed", book_id=book_id, **({"kind": kind} if kind else {}))

    def wipe_failed(self, kind: str | None = None) -> None:
        self._drop("failed", **({"kind": kind} if kind else {}))

    def failed_book_ids(self, kind: str | None = None) -> list[int]:
        return sorted({r["book_id"] for r in registry.failures(self.table("failed"), kind).select("book_id").collect()})

    def failed_entries(self, kind: str | None = None) -> list[dict]:
        return [r.asDict() for r in registry.failures(self.table("failed"), kind).collect()]

    # attributes

    def set_attrs(self, book_id: int, found: dict) -> None:
        listed = {k: [str(x) for x in v] if isinstance(v, list | tuple) else [str(v)] if v not in (None, "") else [] for k, v in found.items()}
        self._upsert("attrs", [(book_id, listed)])

    def get_attrs(self, book_id: int) -> dict[str, list[str]]:
        row = self.table("attrs").where(F.col("book_id") == book_id).first()
        return dict(row["values"]) if row else {}

    def all_attrs(self) -> DataFrame:
        return self.table("attrs")

    def clear_attrs(self, book_id: int) -> None:
        self._drop("attrs", book_id=book_id)

    def attr_book_ids(self) -> list[int]:
        return [r["book_id"] for r in self.table("attrs").select("book_id").orderBy("book_id").collect()]

    def attrs_fields(self) -> DataFrame:
        return self.table("attrs").select("book_id", registry.field_set(F.col("values")).alias("fields"))

    # chunks

    def insert_chunk(self, book_id: int, chunk: dict, vector: Sequence[float], model: str) -> None:
        """Held until commit."""
        self._buffer.append((book_id, chunk["chunk_no"], chunk["text"], list(chunk.get("chapter_path") or []), [float(x) for x in vector], values_model(model)))

    def commit(self, book_id: int | None = None) -> None:
        """Writes what is held, of all books or of one, in one job."""
        out = [r for r in self._buffer if book_id is None or r[0] == book_id]
        if out:
            self.add_chunks(self._rows_of(schemas.TABLES["chunks"].replace("binary", "array<float>"), out))
            self._buffer = [r for r in self._buffer if book_id is not None and r[0] != book_id]

    def add_chunks(self, chunks: DataFrame) -> None:
        """Adds chunks. Vectors given as arrays are brought to length 1 and kept as half-precision bytes; bytes stay."""
        self.publish(added=stored(chunks))

    def delete_chunk(self, book_id: int, chunk_no: int) -> None:
        """A book that loses its last chunk stays registered, with 0."""
        rest = search.delete_chunk(self.table("chunks").where(F.col("book_id") == book_id), book_id, chunk_no)
        one = registry.recount(self.table("books").where(F.col("book_id") == book_id), rest)
        self.publish(dropped=self._rows_of(DROPS, [(book_id, chunk_no)]), changes={"books": (one, None)})

    def count_book_chunks(self, book_id: int) -> int:
        return self.table("chunks").where(F.col("book_id") == book_id).count()

    def book_chunks_text(self, book_id: int) -> list[str]:
        rows = self.table("chunks").where(F.col("book_id") == book_id).orderBy("chunk_no", "model").select("text")
        return [r["text"] for r in rows.collect()]

    def cleanup_stale_models(self, current: str | None = None) -> None:
        stale = registry.stale_models(self.table("chunks"), self.table("books"), values_model(current) if current else None)
        gone = self.table("chunks").join(stale, "model", "left_semi").select("book_id", "chunk_no").distinct()
        if not stale.isEmpty():
            kept = self.table("chunks").join(stale, "model", "left_anti").join(gone, ["book_id", "chunk_no"], "left_semi")
            self.publish(dropped=gone, added=kept)  # a number that another model shares comes again

    # search

    def search(self, query: Sequence[float], limit: int = 20, min_score: float = 0.0, model: str | None = None) -> DataFrame:
        """(book_id, chunk_no, score, fmt, text, chapter_path) of the best books; texts are read for the winners alone.
        Empty while a migration is under way."""
        if self.needs_finalize:
            return schemas.empty(self.spark, "chunks").withColumn("score", F.lit(0.0)).join(self.table("books").select("book_id", "fmt"), "book_id").limit(0)
        chunks = self.table("chunks")
        top = search.search(chunks, query, limit, min_score, values_model(model) if model else None, self.table("books"))
        return search.with_texts(top, chunks)

    def search_book(self, query: Sequence[float], book_id: int, min_score: float = 0.0, model: str | None = None) -> DataFrame:
        return search.search_book(self.table("chunks"), query, book_id, min_score, values_model(model) if model else None)

    # versions

    @property
    def needs_finalize(self) -> bool:
        return bool(self.pending_stages())

    def pending_stages(self, codec: Codec | None = None) -> list[str]:
        stages = ["schema"] if self._read("manifest.json")["version"] < SCHEMA_VERSION else []
        return stages + (["codec"] if codec and resolve(self.get_meta("codec"), codec)[1] else [])

    def stored_codec(self) -> str | None:
        return self.get_meta("codec")

    def finalize_schema(self, progress: Callable[[str], None] | None = None, cancel: Callable[[], bool] | None = None, codec: Codec | None = None) -> None:
        """Runs what is pending, stage by stage; each can be broken off and run again. Errors of `progress` don't count."""
        for stage in self.pending_stages(codec):
            if cancel and cancel():
                raise FinalizeCancelled(stage)
            if progress:
                try:
                    progress(stage)
                except Exception:  # noqa: BLE001, S110  a report must not stop the work
                    pass
            if stage == "codec":
                self.compact(codec)
                continue
            for version in range(self._read("manifest.json")["version"] + 1, SCHEMA_VERSION + 1):
                if cancel and cancel():
                    raise FinalizeCancelled(f"version {version}")
                self._migrate(version)

    def _migrate(self, version: int) -> None:
        """The tables of one version from those of the version before: written, read again, checked by content, and
        published with the version in one manifest. A step that fails, or is broken off, leaves the old state."""
        manifest = self._read("manifest.json")
        folders = {n: self._folders(x) for n, x in manifest["tables"].items() if x}
        whole = lambda n: self._state(n, manifest["tables"][n]) if isinstance(manifest["tables"][n], dict) else self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders[n]))
        old = {n: whole(n) for n in folders}
        new = migrate.STEPS[version](old)
        written, tables = {}, {}
        for name, df in new.items():
            if df is old.get(name):
                written[name], tables[name] = manifest["tables"][name], df
                continue
            folder = f"{name}-{uuid.uuid4().hex}"
            (df.write.partitionBy("model") if name == "chunks" and version >= 2 else df.write).option("compression", "zstd").parquet(f"{self.path}/{folder}")
            written[name] = [["rows", folder]] if name == "chunks" and version >= 2 else folder
            tables[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        if not migrate.CHECKS[version](old, tables):
            raise IndexerError(f"the tables of version {version} don't hold what those before held")
        kept = {f for x in written.values() for f in self._folders(x)}
        self._replace(manifest | {"version": version, "tables": written}, [f for fs in folders.values() for f in fs if f not in kept])

    # whole jobs

    def index_books(self, extracted: DataFrame, embed: Embed, settings: Settings, page_paragraphs: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Indexes books (book_id, fmt, size, mtime, extracted struct<kind, pages, text, error>): guards, chunks, vectors,
        and their places in all registries, published together. Books that fail keep their old chunks if reading
        them failed, and lose them if too little text was left."""
        from glyphlake.operators import pages as html

        extracted, source = self._stage(extracted, "extracted")  # books are read and parsed once
        todo = extracted.withColumn("parts", F.when(F.col("extracted.kind") == "text", F.array("extracted.text")).otherwise(F.col("extracted.pages")))
        checked = packing.guard(todo.where("extracted.kind <> 'error'"), "book_id", "parts", MIN_EXTRACTED_CHARS)
        fit = todo.join(checked.where("action = 'index'").select("book_id"), "book_id", "left_semi")
        target, overlap, cap = settings.effective_target, settings.overlap_chars, settings.chunk_token_cap
        texts = packing.pack_texts(fit.where("extracted.kind = 'text'").select("book_id", "extracted.text"), "book_id", "text", target, overlap, cap)
        spread = fit.where("extracted.kind = 'pages'").select("book_id", F.posexplode("extracted.pages").alias("page_no", "html")).withColumn("page", F.struct("book_id", "page_no"))
        made = (page_paragraphs or (lambda df: html.page_paragraphs(df, "page", "html")))(spread).select("page.book_id", "page.page_no", "paragraphs")
        units = html.book_paragraphs(made, "book_id", "page_no")
        pages = packing.pack_units(units, "book_id", "paragraphs", target, overlap, cap)
        rows = packing.chunk_rows(texts.unionByName(pages), "book_id", settings.max_chunks_per_book)
        model = values_model(settings.embed.model)
        staged, folder = self._stage(stored(embedded(rows, embed, settings.embed).withColumn("model", F.lit(model))), "staged")
        done = staged.groupBy("book_id").agg(F.count("*").cast("int").alias("n_chunks"))
        thin = checked.select("book_id").join(done, "book_id", "left_anti")
        unread = todo.where("extracted.kind = 'error'").select("book_id", F.col("extracted.error").alias("error"))
        failed = thin.withColumn("error", F.lit("too little text")).unionByName(unread).withColumn("kind", F.lit("index"))
        cleared = done.select("book_id").union(thin)
        held = self.table("chunks").select("book_id").distinct().join(cleared, "book_id", "left_semi")  # only what there is is dropped
        info = values.file_info(F.col("size"), F.col("mtime"))
        books = done.join(extracted.select("book_id", "fmt"), "book_id").withColumn("indexed_at", F.lit(int(time.time()))).withColumn("model", F.lit(model))
        self.publish(
            added=staged,
            dropped=None if held.isEmpty() else held.withColumn("chunk_no", F.lit(None)),
            changes={
                "books": (books, cleared),
                "failed": (failed, done.select("book_id", F.lit("index").alias("kind"))),
                "file_info": (extracted.select("book_id", "fmt", info.alias("i")).where("i is not null").select("book_id", "fmt", "i.*"), None),
                "queue_index": (None, extracted),
            },
        )
        for name in (folder, source):
            self._fs.delete(self._at(name), True)

    def reconcile(self, library: DataFrame, current_model: str | None = None) -> DataFrame:
        """Compares (book_id, fmt, size, mtime) with the registries, applies what follows and returns the actions."""
        tables = {n: self.table(n) for n in schemas.TABLES if n not in ("meta", "chunks")}
        found = registry.reconcile(library, tables)
        folder = f"actions-{uuid.uuid4().hex}"  # the tables it was worked out from are replaced below
        found.write.parquet(f"{self.path}/{folder}")
        actions = self.spark.read.parquet(f"{self.path}/{folder}")
        gone = actions.where("action = 'remove'").select("book_id", F.lit(None).cast("int").alias("chunk_no"))
        todo = actions.where("action = 'index'").select("book_id", F.lit(0).alias("priority"))
        none = gone.isEmpty()
        changes = {} if none else {n: (None, self._keys_of(n, gone)) for n in tables}
        if not todo.isEmpty():
            changes["queue_index"] = (todo, changes.get("queue_index", (None, None))[1])
        self.publish(dropped=None if none else gone, changes=changes)
        if current_model:
            self.cleanup_stale_models(current_model)
        return actions


    def extract_books(self, model, settings: Settings) -> DataFrame:
        """Extracts attributes of forced and pending books, keeps what was found and what failed, and returns both. Runs once
        the indexing queue is empty, so that embedding work is done before any question to a language model."""
        from glyphlake.operators import attributes

        if not self.table("queue_index").isEmpty():
            return schemas.empty(self.spark, "attrs").withColumn("error", F.lit(None).cast("string"))
        names = [a.name for a in settings.enabled()]
        pending = registry.pending_attributes(self.table("books"), self.table("attrs"), names, self.table("failed"))
        todo = pending.union(self.table("queue_attrs").select("book_id")).distinct()
        folder = f"attrs-{uuid.uuid4().hex}.new"
        chunks = self.table("chunks").join(todo, "book_id", "left_semi").select("book_id", "chunk_no", "text")
        attributes.extract_attributes(chunks, model, settings).write.parquet(f"{self.path}/{folder}")
        found = self.spark.read.parquet(f"{self.path}/{folder}")
        failed = found.where("error is not null").select("book_id", F.lit("attr").alias("kind"), "error")
        tried = found.select("book_id", F.lit("attr").alias("kind"))
        self.publish(changes={"attrs": (found.where("error is null"), None), "failed": (failed, tried), "queue_attrs": (None, todo)})
        return found

    # what users ask for

    def ask(self, text: str, embed: Embed, limit: int = MAX_RESULTS, min_score: float = 0.2) -> tuple[DataFrame, list[float]]:
        """(results, query vector): embeds the question and searches; the vector serves further drill-downs."""
        if not text.strip():
            raise ValueError("nothing to search for")
        vector = embed([text.strip()])[0]
        return self.search(vector, min(limit, MAX_RESULTS), search.clamp_min_score(min_score)), vector

    def reindex(self, book_id: int) -> None:
        self.enqueue_indexing(book_id, PRIORITY_PER_BOOK)

    def reindex_all(self, library: DataFrame) -> None:
        self._queue_books(library.where("fmt is not null"))

    def reindex_new_and_failed(self, library: DataFrame) -> None:
        self._queue_books(registry.new_and_failed(library, self.table("books"), self.table("failed")))

    def _queue_books(self, ids: DataFrame) -> None:
        rows = ids.select("book_id", F.lit(PRIORITY_DEFAULT).alias("priority"))
        self.publish(changes={"queue_index": (rows, None)})

    def status(self, library: DataFrame, settings: Settings) -> list[str]:
        pending = registry.pending_attributes(self.table("books"), self.table("attrs"), [a.name for a in settings.enabled()])
        return registry.status_lines(registry.status(library, self.table("books"), pending, self.table("failed")).first())


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks with their vectors as the store keeps them: length 1, two bytes a number."""
    if dict(chunks.dtypes)["vector"] == "binary":
        return chunks
    return chunks.withColumn("vector", vectors.half_bytes(vectors.normalized(F.col("vector"))))


def values_model(model: str) -> str:
    """`functions.values.normalize_model` for one name, on the driver."""
    import re

    name = model.strip().partition(":")[0]
    name = re.sub("(?i)-gguf$", "", name.partition("/")[2] if "/" in name else name)
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_") or "model"
