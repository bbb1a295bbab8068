"""Attribute extraction: a language model's structured answers over parts of a book, merged into one value a field.

The model is a callable that is handed in. Parts of all books are mapped at once (one Arrow stream a task); tags are
merged in Spark's own expressions, and the model is asked again only where parts disagree about a text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphlake.functions import values
from glyphlake.operators.packing import estimate, map_groups, sample, weigh
from glyphlake.settings import STRUCTURED_RETRIES, Attribute, Settings, text_budget_tokens

#: (prompt, names and types of the fields, options) -> values by field name, or None
Model = Callable[[str, Sequence[tuple[str, str]], dict[str, Any]], dict[str, Any] | None]

VALUES = "map<string,array<string>>"


def answer_schema(fields: Sequence[Attribute]) -> T.StructType:
    """What an answer looks like: tags as lists, everything else as one text, all optional."""
    return T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.type == "tags" else T.StringType(), True, {"description": f.description}) for f in fields])


def asked_for(field: Attribute) -> str:
    """One field as a request states it: name, what it is, the form of the value and its language."""
    form = {"tags": "a list of short tags", "category": "one value"}.get(field.type, "a text")
    language = {"": "", "book": ", in the language the book is written in"}.get(field.language, f", in {field.language}")
    return f"{field.name} ({form}{language}): {field.description}"


def prompt(text: str, fields: Sequence[Attribute]) -> str:
    """A request for the fields of one part of a book; the text comes last."""
    wanted = "".join(f"* {asked_for(f)}\n" for f in fields)
    return f"You catalogue books. Work out these fields from the part of a book that follows:\n{wanted}Answer with the fields only; a field the text says nothing about is null.\n=== TEXT ===\n{text}"


def ends_kept(count: int, most: int) -> list[int]:
    """Places of at most `most` of so many values, the middle left out, the first ones rather than the last."""
    return list(range(count)) if count <= most else [*range((most + 1) // 2), *range(count - most // 2, count)]


def merge_prompt(pending: Sequence[tuple[Attribute, Sequence[str]]], most: int | None = None) -> str:
    """A request for one value a field out of the ordered values of a book's parts. If it would have more than `most`
    estimated tokens, the longest lists give up middle values, down to two; how many follows from what each line costs."""
    head = "The parts of one book, in order, gave different values for these fields. Settle each on one value: what comes first holds unless something later corrects it, and a text should read as one.\n"
    lines = [[f"* {asked_for(f)}\n", *(f"  part {i}: {v}\n" for i, v in enumerate(vs, 1))] for f, vs in pending]
    tail = "Answer with the fields only."

    def chosen(longest: int) -> list[str]:
        return [x for field in lines for x in (field[0], *(field[1 + k] for k in ends_kept(len(field) - 1, longest)))]

    longest = max((len(field) - 1 for field in lines), default=0)
    if most is not None and longest > 2:
        cost = {x: weigh(x) for field in lines for x in field}
        room = most - weigh(head + tail)
        fits = lambda n: int(sum(cost[x] for x in chosen(n)) + 0.5) <= room
        longest = max(2, bisect_left(range(3, longest + 1), True, key=lambda n: not fits(n)) + 2)
    return head + "".join(chosen(longest)) + tail


def answer(model: Model, text: str, fields: Sequence[Attribute], options: dict[str, Any] | None = None, retries: int = STRUCTURED_RETRIES) -> dict[str, Any] | None:
    """The model's answer; an answer that can't be read (ValueError) is asked for again, other errors are not caught."""
    wanted = [(f.name, f.type) for f in fields]
    for left in range(retries, -1, -1):
        try:
            return model(text, wanted, options or {})
        except ValueError:
            if not left:
                raise


def as_list(value: Any, kind: str) -> list[str]:
    """A value as `functions.values` would normalise it: tags as several texts, others as one or none."""
    if value is None:
        return []
    if isinstance(value, list | tuple):
        shown = [str(x) for x in value if str(x).strip()]
        return [x.strip() for x in shown] if kind == "tags" else [", ".join(shown)] if shown else []
    text = str(value).strip()
    if not text or text.lower() in values.NO_VALUE:
        return []
    return [p for x in text.split(",") if (p := x.strip(" ."))] if kind == "tags" else [text]


def parts_of_books(chunks: DataFrame, settings: Settings) -> DataFrame:
    """(book_id, part, text): one sampled text a book, or, in full-text mode, every group of its chunks in order."""
    fields = settings.enabled()
    budget = text_budget_tokens(settings.attr_context_tokens, estimate(prompt("", fields)), settings.attr_token_scale)
    budget = max(1, int(budget / settings.attr_token_scale))
    full = settings.attr_mode == "fulltext"
    ordered = chunks.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("c")).select("book_id", F.col("c.text").alias("texts"))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book, texts in zip(frame["book_id"], frame["texts"], strict=True):
                texts = list(texts)
                parts = ["\n\n".join(texts[i] for i in g) for g in map_groups(texts, tokens=budget)] if full else [sample(texts, tokens=budget)]
                rows += [(book, n, p) for n, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["book_id", "part", "text"])

    return ordered.mapInPandas(made, "book_id long, part int, text string")


def map_parts(parts: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """(book_id, part, values, error): one answer a part; an error is a row, not the end of the job."""
    fields, options = settings.enabled(), settings.attr_template_kwargs

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from glyphlake.settings import template_kwargs

        for frame in frames:
            rows = []
            for book, part, text in zip(frame["book_id"], frame["part"], frame["text"], strict=True):
                try:
                    got = answer(model, prompt(text, fields), fields, template_kwargs(options))
                    rows.append((book, part, None if got is None else [(f.name, as_list(got.get(f.name), f.type)) for f in fields], None))
                except Exception as e:  # noqa: BLE001  any failure of a book is recorded as that book's
                    rows.append((book, part, None, repr(e)))
            yield pd.DataFrame({"book_id": [r[0] for r in rows], "part": [r[1] for r in rows], "entries": [None if r[2] is None else [{"name": n, "found": v} for n, v in r[2]] for r in rows], "error": [r[3] for r in rows]})

    kind = T.StructType.fromDDL("book_id long, part int, entries array<struct<name:string,found:array<string>>>, error string")
    return parts.mapInPandas(made, kind).select("book_id", "part", F.map_from_entries("entries").alias("values"), "error")


def merge_parts(mapped: DataFrame, fields: Sequence[Attribute]) -> DataFrame:
    """(book_id, values, open): per field the tags of all parts, spelled once each, or the one text all parts agree on.
    `open` has the fields whose parts differ, with their distinct texts in order."""
    entries = F.struct("part", F.map_entries(F.coalesce("values", F.create_map().cast(VALUES))).alias("entries"))  # maps have no order
    ordered = mapped.groupBy("book_id").agg(F.array_sort(F.collect_list(entries)).alias("p"))
    ordered = ordered.select("book_id", F.transform("p", lambda x: F.map_from_entries(x["entries"])).alias("p"))
    names, closed, unsettled = [F.lit(f.name) for f in fields], [], []
    for f in fields:
        every = F.flatten(F.transform("p", lambda x: F.coalesce(x[F.lit(f.name)], F.array().cast("array<string>"))))  # noqa: B023
        if f.type == "tags":
            closed.append(values.normalize_tags(F.array_distinct(every)))
            unsettled.append(F.array().cast("array<string>"))
        else:
            distinct = values.distinct_values(every)
            closed.append(F.slice(distinct, 1, 1))
            unsettled.append(F.when(F.size(distinct) > 1, distinct).otherwise(F.array().cast("array<string>")))
    pick = lambda columns: F.map_from_arrays(F.array(*names), F.array(*columns))
    return ordered.select("book_id", pick(closed).alias("values"), F.map_filter(pick(unsettled), lambda _, v: F.size(v) > 0).alias("open"))


def settle(merged: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """(book_id, values, error): one more question for books with open fields; a null answer leaves the first value."""
    fields, most = {f.name: f for f in settings.enabled()}, settings.attr_context_tokens

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, errors = [], []
            for entries in frame["open"]:
                pending = [(fields[n], list(v)) for n, v in dict(entries).items()]
                try:
                    got = answer(model, merge_prompt(pending, most), [f for f, _ in pending]) or {}
                    found.append([{"name": f.name, "found": as_list(got.get(f.name), "text") or v[:1]} for f, v in pending])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    found.append([])
                    errors.append(repr(e))
            yield pd.DataFrame({"book_id": frame["book_id"], "entries": found, "error": errors})

    asked = merged.where(F.size("open") > 0).select("book_id", "open").mapInPandas(made, T.StructType.fromDDL("book_id long, entries array<struct<name:string,found:array<string>>>, error string"))
    both = merged.join(asked, "book_id", "left")
    settled = F.coalesce(F.map_from_entries("entries"), F.create_map().cast(VALUES))
    return both.select("book_id", F.map_zip_with("values", settled, lambda _, a, b: F.coalesce(b, a)).alias("values"), "error")


def extract_attributes(chunks: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """(book_id, values, error) of every book with chunks: values has each enabled field, an empty list for no value."""
    mapped = map_parts(parts_of_books(chunks, settings), model, settings)
    failed = mapped.where("error is not null").groupBy("book_id").agg(F.min_by("error", "part").alias("error"))
    settled = settle(merge_parts(mapped.where("error is null"), settings.enabled()), model, settings).join(failed.select("book_id"), "book_id", "left_anti")
    return settled.unionByName(failed.withColumn("values", F.lit(None).cast(VALUES)))


def mirror(attrs: DataFrame, fields: Sequence[Attribute]) -> DataFrame:
    """One column a field that is enabled, named by its label: tags as a list, the others as one text, null if empty."""
    return attrs.select("book_id", *[values.column_value(F.col("values")[f.name], f.type).alias(f.label) for f in fields if f.enabled])


def tag_counts(attrs: DataFrame, field: str) -> DataFrame:
    """(key, tag, n) over all books: equal tags by key, the shortest spelling, and how many books have it."""
    rows = attrs.select("book_id", F.explode(F.col("values")[field]).alias("tag")).withColumn("key", values.tag_key(F.col("tag")))
    return rows.groupBy("key").agg(F.min_by("tag", F.struct(F.length("tag"), F.col("tag"))).alias("tag"), F.count_distinct("book_id").alias("n"))


def ranked_parts(parts: DataFrame) -> DataFrame:
    """Parts with how many their book has, for reports of progress."""
    return parts.withColumn("of", F.count("*").over(W.partitionBy("book_id")))
