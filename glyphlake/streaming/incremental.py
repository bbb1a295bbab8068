"""Incremental operation on Structured Streaming: snapshots of a library as a stream of files, queues drained by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphlake.engine import VectorStore

SNAPSHOT = "snapshot long, book_id long, fmt string, size long, mtime long"


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """The rows of the newest snapshot in a batch; older ones that came late with it are superseded."""
    top = rows.agg(F.max("snapshot").alias("snapshot"))
    return rows.join(F.broadcast(top), "snapshot", "left_semi")


def reconcile_stream(spark: SparkSession, path: str, store: VectorStore, checkpoint: str, interval: str | None = None, files: int | None = None) -> StreamingQuery:
    """Reconciles the store with each new snapshot (Parquet files of SNAPSHOT) below path. A batch that is run again after
    a failure finds nothing left to do. Without an interval it handles what is there and stops."""
    stream = spark.readStream.schema(SNAPSHOT)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            store.reconcile(latest_snapshot(rows).drop("snapshot"))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def drain(store: VectorStore, index: Callable[[list[int]], None], extract: Callable[[list[int]], None], batch: int = 64, stop: Callable[[], bool] = lambda: False) -> None:
    """Works the queues off: all indexing before any extraction, the highest priority first. Queues are read anew before
    each batch, so a request that comes meanwhile is next; a paused store does nothing."""
    while not stop() and not store.paused:
        if todo := store.next_indexing(batch):
            index(todo)
            store.dequeue_many("queue_index", todo)
        elif todo := store.next_attrs(batch):
            extract(todo)
            store.dequeue_many("queue_attrs", todo)
        else:
            return


def best_chunks_stream(chunks: DataFrame, query: list[float]) -> DataFrame:
    """(book_id, score, chunk_no) kept up to date over a stream of chunks: a running best of each book."""
    from glyphlake.operators.search import scored

    best = F.max(F.struct(F.col("score"), (-F.col("chunk_no")).alias("n")))
    return scored(chunks, query).groupBy("book_id").agg(best.alias("b")).select("book_id", "b.score", (-F.col("b.n")).alias("chunk_no"))
