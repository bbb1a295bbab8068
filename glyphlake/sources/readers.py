"""Sources: book files as text or pages, with errors as values; raw bytes come through Spark's own readers."""

from __future__ import annotations

import html
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.values import pick_format
from glyphlake.settings import FORMAT_PRIORITY

#: Fixed value: encodings that plain text is tried in.
ENCODINGS = ("utf-8", "utf-16", "latin-1")
EXTRACTED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
_ARROW = pa.struct([("kind", pa.string()), ("pages", pa.list_(pa.string())), ("text", pa.string()), ("error", pa.string())])


def decode(data: bytes) -> str:
    """The first encoding that fits, in composed form."""
    for name in ENCODINGS:
        try:
            return unicodedata.normalize("NFC", data.decode(name))
        except UnicodeDecodeError:
            continue
    raise ValueError("not text")


def spine(data: bytes) -> list[str]:
    """The pages of an EPUB in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = next(e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        package = list(ElementTree.fromstring(book.read(root)).iter())
        files = {e.get("id"): e.get("href") for e in package if local(e) == "item"}
        base = root.rpartition("/")[0]
        paths = [files[e.get("idref")] for e in package if local(e) == "itemref" and e.get("idref") in files]
        return [decode(book.read(f"{base}/{p}" if base else p)) for p in paths]


def local(element) -> str:
    """An element's name without its namespace."""
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def fiction_book(data: bytes) -> list[str]:
    """The bodies of an FB2 file, or the one in a zipped file, as pages of HTML: titles as headings by depth, paragraphs."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as packed:
            data = packed.read(next(n for n in packed.namelist() if n.lower().endswith(".fb2")))
    pages = []
    for body in (e for e in ElementTree.fromstring(data) if local(e) == "body"):
        out, todo = [], [(body, 1)]
        while todo:
            node, depth = todo.pop()
            name = local(node)
            if name == "title":
                title = " ".join(" ".join("".join(p.itertext()).split()) for p in node)
                out.append(f"<h{min(depth, 6)}>{html.escape(title)}</h{min(depth, 6)}>")
            elif name in ("p", "v", "subtitle", "text-author", "td", "th"):
                out.append(f"<p>{html.escape(''.join(node.itertext()))}</p>")
            else:
                deeper = depth + (name == "section")
                todo += [(child, deeper) for child in reversed(node)]
        pages.append("".join(out))
    return pages


def word_document(data: bytes) -> list[str]:
    """The text of a DOCX file as one page of HTML: heading styles as headings, other paragraphs as such."""
    with zipfile.ZipFile(io.BytesIO(data)) as packed:
        root = ElementTree.fromstring(packed.read("word/document.xml"))
    out = []
    for p in (e for e in root.iter() if local(e) == "p"):
        style = next((v for e in p.iter() if local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
        m = re.fullmatch(r"[Hh]eading ?([1-9])|([Tt]itle)", style)
        level = 0 if not m else 1 if m[2] else min(6, int(m[1]))
        parts = [(e.text or "") if local(e) == "t" else "\t" if local(e) == "tab" else "<br>" if local(e) in ("br", "cr") else None for e in p.iter()]
        text = "".join(x if x == "<br>" else html.escape(x) for x in parts if x is not None)
        out.append(f"<h{level}>{text}</h{level}>" if level else f"<p>{text}</p>")
    return ["".join(out)]


#: What the standard library can read; other formats need readers that are handed in.
READERS = {"TXT": decode, "TEXT": decode, "HTML": lambda d: [decode(d)], "HTM": lambda d: [decode(d)], "XHTML": lambda d: [decode(d)], "EPUB": spine, "FB2": fiction_book, "FBZ": fiction_book, "DOCX": word_document}


def extract(data: bytes, fmt: str, readers=None) -> dict:
    """kind 'text' or 'pages' with what was read, or 'error' with why not. Formats that need a library of their own are
    read by `readers` (format -> bytes -> text or list of pages)."""
    out = {"kind": "error", "pages": None, "text": None, "error": None}
    try:
        fmt = fmt.upper()
        own = (READERS | (readers or {})).get(fmt)
        if own is None:
            raise ValueError(f"no reader for {fmt}")
        got = own(data)
        return out | ({"kind": "text", "text": got} if isinstance(got, str) else {"kind": "pages", "pages": list(got)})
    except Exception as e:  # noqa: BLE001  a book that can't be read is a row that says so
        return out | {"error": f"{type(e).__name__}: {e}"}


def read_books(spark: SparkSession, path: str, readers=None) -> DataFrame:
    """(path, fmt, size, mtime, extracted) of every file below path; the format is the file's ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.upper(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("fmt"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(d, f, readers) for d, f in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, _ARROW)], names=["path", "fmt", "size", "mtime", "extracted"])

    return rows.mapInArrow(made, T.StructType([*rows.schema.fields[:4], T.StructField("extracted", EXTRACTED)]))


def library(files: DataFrame, id_col: str = "book_id", priority=FORMAT_PRIORITY, readers=None) -> DataFrame:
    """(book_id, fmt, size, mtime): of each book's files (book_id, fmt, size, mtime) the one in the preferred format. Formats
    that can be read, here or by `readers`, come before those that can't, each part in the order of `priority`."""
    known = {k.upper() for k in READERS | (readers or {})}
    priority = tuple(sorted(dict.fromkeys([*(p.upper() for p in priority), *sorted(known)]), key=lambda p: p not in known))
    best = files.groupBy(id_col).agg(pick_format(F.array_sort(F.collect_list("fmt")), priority).alias("fmt"))
    return files.join(best, [id_col, "fmt"], "left_semi").groupBy(id_col, "fmt").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime")).unionByName(best.where("fmt is null").select(id_col, "fmt", F.lit(None).cast("long").alias("size"), F.lit(None).cast(dict(files.dtypes)["mtime"]).alias("mtime")))


def base_url(url: str) -> str:
    """Without a closing slash and a closing /v1."""
    return re.sub(r"/v1$", "", url.rstrip("/"))
