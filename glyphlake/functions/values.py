"""Expressions over models, files, attribute values and tags, and over what older stores kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.functions.text import SPACE, squeeze, strip
from glyphlake.settings import FORMAT_PRIORITY, UNREADABLE_FORMATS

#: Texts that stand for no value.
NO_VALUE = ("null", "none", "n/a", "unknown")


def normalize_model(c: Column) -> Column:
    """The name without what follows a colon, a vendor before the first slash and a final -gguf; lower case, other
    characters as single underscores; 'model' if nothing is left."""
    base = F.substring_index(strip(F.coalesce(c, F.lit(""))), ":", 1)
    name = F.regexp_replace(F.regexp_replace(base, "^[^/]*/", ""), "(?i)-gguf$", "")
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^_+|_+$", ""), F.lit("")), F.lit("model"))


def model_table_name(model: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(model, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.concat(F.lit("chunks_"), F.coalesce(F.nullif(F.lower(slug), F.lit("")), F.lit("model"))), 1, 80)


def pick_format(formats: Column, priority: tuple[str, ...] = FORMAT_PRIORITY) -> Column:
    """The first wanted format that is there, in any case; else the first readable one; else the first; null for none.

    Of two spellings of one format the later counts."""
    wanted = F.array(*[F.lit(p.upper()) for p in priority])
    spelled = F.transform(wanted, lambda w: F.try_element_at(F.filter(formats, lambda f: F.upper(f) == w), F.lit(-1)))
    hits = F.filter(spelled, lambda f: f.isNotNull())
    readable = F.filter(formats, lambda f: ~F.upper(f).isin(*UNREADABLE_FORMATS))
    return F.coalesce(F.get(hits, F.lit(0)), F.get(readable, F.lit(0)), F.get(formats, F.lit(0)))


def epoch_seconds(c: Column) -> Column:
    """A timestamp, number or ISO text as whole seconds, cut off, not rounded; null for what is neither."""
    text = c.cast("string")
    number = text.try_cast("double")
    moment = F.unix_micros(text.try_cast("timestamp")) / F.lit(1_000_000)
    found = F.coalesce(number, moment)
    return F.when(found < 0, F.ceil(found)).otherwise(F.floor(found)).cast("long")


def file_info(size: Column, mtime: Column) -> Column:
    """struct(size, mtime_s), null if either is missing."""
    n, t = size.try_cast("long"), epoch_seconds(mtime)
    return F.when(n.isNotNull() & t.isNotNull(), F.struct(n.alias("size"), t.alias("mtime_s")))


def same_file(size: Column, mtime: Column, old_size: Column, old_mtime_s: Column) -> Column:
    return F.coalesce((size.try_cast("long") == old_size) & (epoch_seconds(mtime) == old_mtime_s), F.lit(False))


def is_empty_value(c: Column) -> Column:
    s = strip(c)
    return c.isNull() | (s == "") | F.lower(s).isin(*NO_VALUE)


def text_value(c: Column) -> Column:
    """A stripped text; empty for no value."""
    return F.when(is_empty_value(c), F.lit("")).otherwise(strip(c))


def tags_value(c: Column) -> Column:
    """The parts between commas without spaces and dots around; none for no value."""
    parts = F.transform(F.split(strip(c), ","), lambda p: F.btrim(p, F.lit(" .")))
    return F.when(is_empty_value(c), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda p: p != ""))


def text_of_list(c: Column) -> Column:
    """A list where a text is wanted: its non-blank elements as they are, with commas between."""
    return F.array_join(F.filter(c, lambda x: x.isNotNull() & (strip(x) != "")), ", ")


def tags_of_list(c: Column) -> Column:
    return F.filter(F.transform(F.filter(c, lambda x: x.isNotNull()), strip), lambda x: x != "")


def tag_key(c: Column) -> Column:
    """What equal tags have in common: case, white space, the separators / & + and 'and', and closing remarks in
    parentheses make no difference. A tag of nothing else is its own key."""
    flat = squeeze(F.lower(strip(c)))
    bare = F.regexp_replace(flat, rf"(?U)({SPACE}*\([^()]*\))+{SPACE}*$", "")
    joined = F.regexp_replace(bare, rf"(?U){SPACE}*(?:[/&+]|\band\b){SPACE}*", "|")
    key = F.regexp_replace(F.regexp_replace(joined, r"\|+", "|"), r"^\|+|\|+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lower(strip(c)))


def _bound(c: Column, use) -> Column:
    """use(c) with c worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def normalize_tags(tags: Column) -> Column:
    """One spelling a key, the shortest, of equals the earliest, in the order in which the keys come first. Keys are worked
    out once and sorted, twice: the heads of equal keys are their first places and their best spellings."""
    kept = F.filter(F.transform(F.filter(tags, lambda t: t.isNotNull()), strip), lambda t: t != "")
    keyed = F.transform(kept, lambda t, i: F.struct(tag_key(t).alias("key"), F.length(t).alias("n"), i.alias("i"), t.alias("t")))
    heads = lambda rows: _bound(F.array_sort(rows), lambda s: F.filter(s, lambda x, j: (j == 0) | (x["key"] != F.get(s, j - 1)["key"])))

    def chosen(rows: Column) -> Column:
        firsts = heads(F.transform(rows, lambda x: F.struct(x["key"].alias("key"), x["i"].alias("i"))))
        return F.array_sort(F.zip_with(firsts, heads(rows), lambda f, x: F.struct(f["i"].alias("i"), x["t"].alias("t"))))

    return F.transform(_bound(keyed, chosen), lambda x: x["t"])


def distinct_values(values: Column) -> Column:
    """The first spelling of each value, case aside, in order; nulls are left out. Keys are worked out once and sorted."""
    keyed = F.filter(F.transform(values, lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("i"), v.alias("v"))), lambda x: x["v"].isNotNull())
    heads = _bound(F.array_sort(keyed), lambda s: F.filter(s, lambda x, j: (j == 0) | (x["key"] != F.get(s, j - 1)["key"])))
    return F.transform(F.array_sort(F.transform(heads, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def column_value(values: Column, kind: str) -> Column:
    """A list as a mirrored column of this type holds it: tags as a list, others as one text, null if empty."""
    kept = tags_of_list(values)
    return F.when(F.size(kept) > 0, kept if kind == "tags" else F.array_join(kept, ", "))


def legacy_file_info(c: Column) -> Column:
    """'FMT|size|mtime' as struct(fmt, size, mtime_s), null if malformed."""
    parts = F.split(c, r"\|")
    size, mtime = parts[1].try_cast("long"), F.floor(parts[2].try_cast("decimal(38,9)")).cast("long")
    return F.when((F.size(parts) == 3) & size.isNotNull() & mtime.isNotNull(), F.struct(parts[0].alias("fmt"), size.alias("size"), mtime.alias("mtime_s")))


def legacy_failures(c: Column) -> Column:
    """JSON {id: {error}} as array<struct(book_id, error)>; what is malformed is left out."""
    entries = F.map_entries(F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")))
    read = F.transform(entries, lambda e: F.struct(e["key"].try_cast("long").alias("book_id"), F.get_json_object(e["value"], "$.error").alias("error")))
    return F.filter(read, lambda e: e["book_id"].isNotNull() & e["error"].isNotNull())
