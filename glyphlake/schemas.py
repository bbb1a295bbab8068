"""Schemas of an engine's tables, and empty tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "books": "book_id long, fmt string, indexed_at long, n_chunks int, model string",
    "queue_index": "book_id long, priority int",
    "queue_attrs": "book_id long, priority int",
    "attrs": "book_id long, values map<string,array<string>>",
    "failed": "book_id long, kind string, error string",
    "file_info": "book_id long, fmt string, size long, mtime_s long",
    "meta": "key string, value string",
    "chunks": "book_id long, chunk_no int, text string, chapter_path array<string>, vector binary, model string",
}
KEYS = {"books": ["book_id"], "queue_index": ["book_id"], "queue_attrs": ["book_id"], "attrs": ["book_id"], "failed": ["book_id", "kind"], "file_info": ["book_id"], "meta": ["key"], "chunks": ["model", "book_id", "chunk_no"]}

#: Tables whose values are maxima of what was put there since a row was last taken away.
HIGHEST = ("queue_index", "queue_attrs")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
