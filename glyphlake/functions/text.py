"""Text expressions: white space, scripts, token estimates, snippets, labels. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.settings import CONTEXT_OVERHEAD_TOKENS, MIN_CHUNK_CHARS, MIN_TEXT_CHARS, PROMPT_OVERHEAD_TOKENS, TOKEN_HUNDREDTHS, TOKENS_PER_CHAR

#: Ranges of code points by script tier; everything else counts as latin.
SCRIPTS = {
    "dense": ((0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2EBEF)),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "nonlatin": ((0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0900, 0x097F), (0x0E00, 0x0E7F), (0x10A0, 0x10FF)),
}
TIERS = ("dense", "arabic", "nonlatin")
#: What Python calls white space and Java's Unicode \s does not: the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def char_class(tier: str) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SCRIPTS[tier])


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def script_counts(c: Column) -> Column:
    """struct(dense, arabic, nonlatin, latin) of code points; a null text counts as empty."""
    c = F.coalesce(c, F.lit(""))
    far = F.regexp_replace(c, r"[\x00-\x{36F}]+", "")  # mostly nothing is left, so that the tiers cost nothing
    found = [F.length(F.regexp_replace(far, f"[^{char_class(t)}]+", "")) for t in TIERS]
    return F.struct(*[n.alias(t) for n, t in zip(found, TIERS, strict=True)], (F.length(c) - found[0] - found[1] - found[2]).alias("latin"))


def weighed(counts: Column) -> Column:
    """Hundredths of tokens, a whole number."""
    total = counts["dense"].cast("long") * TOKEN_HUNDREDTHS["dense"]
    for tier in ("arabic", "nonlatin", "latin"):
        total = total + counts[tier].cast("long") * TOKEN_HUNDREDTHS[tier]
    return total


def estimate_tokens(c: Column) -> Column:
    """At least 1, rounded half up; a half is met exactly."""
    return F.greatest(F.lit(1), F.floor(weighed(script_counts(c)) / F.lit(100) + F.lit(0.5)).cast("int"))


def chunk_chars(context_tokens: Column, scale: float = 1.0) -> Column:
    """`settings.max_chunk_chars` of a column."""
    return F.greatest(F.lit(MIN_CHUNK_CHARS), ((context_tokens - CONTEXT_OVERHEAD_TOKENS) / F.lit(TOKENS_PER_CHAR["latin"] * scale)).cast("long"))


def budget_chars(context_tokens: Column, scale: float = 1.0) -> Column:
    """`settings.text_budget_chars` of a column."""
    return F.greatest(F.lit(MIN_TEXT_CHARS), ((context_tokens - PROMPT_OVERHEAD_TOKENS) / F.lit(TOKENS_PER_CHAR["latin"] * scale)).cast("long"))


def chapter_label(path: Column) -> Column:
    return F.array_join(path, " > ")


def chapter_path(label: Column) -> Column:
    """Back from a label; empty parts are dropped, and a heading with ' > ' inside comes apart."""
    return F.filter(F.split(label, " > "), lambda x: x != "")


def snippet(c: Column, most: int = 240) -> Column:
    """On one line; of a longer text an ellipsis and its end."""
    flat = F.translate(c, "\n", " ")
    return F.when(F.length(flat) > most, F.concat(F.lit("…"), F.right(flat, F.lit(most)))).otherwise(flat)


def paragraphs(c: Column) -> Column:
    """Non-empty stripped paragraphs between blank lines."""
    return F.filter(F.transform(F.split(c, rf"(?U)\n{SPACE}*\n"), strip), lambda p: p != "")


def search_phrase(c: Column, most: int = 400) -> Column:
    """The longest paragraph (the first of equals); of one that is too long, a slice from its first quarter on."""
    parts = paragraphs(c)
    longest = F.reduce(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    cut = F.when(F.length(longest) > most, F.substr(longest, (F.length(longest) / 4).cast("int") + 1, F.lit(most))).otherwise(longest)
    return F.when(F.size(parts) == 0, F.substring(c, 1, most)).otherwise(strip(cut))


def book_label(book_id: Column, title: Column, authors: Column) -> Column:
    """'"title" by a, b [id n]', or 'book n' where the library knows nothing of it (a null title and null authors)."""
    named = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != ""))
    by = F.when(F.size(named) > 0, F.concat(F.lit(" by "), F.array_join(named, ", "))).otherwise(F.lit(""))
    shown = F.coalesce(F.nullif(title, F.lit("")), F.lit("?"))
    full = F.concat(F.lit('"'), shown, F.lit('"'), by, F.lit(" [id "), book_id.cast("string"), F.lit("]"))
    return F.when(title.isNull() & authors.isNull(), F.concat(F.lit("book "), book_id.cast("string"))).otherwise(full)


def human_name(name: Column) -> Column:
    """Underscores as spaces, every letter that no letter stands before in upper case, the others in lower case."""
    spread = F.regexp_replace(F.lower(F.translate(name, "_", " ")), r"([^\p{L}]*)(\p{L}+)", "$1\u0001$2\u0001")
    return F.array_join(F.transform(F.split(spread, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def column_title(title: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), human_name(name))


def column_key(label: Column) -> Column:
    return F.concat(F.lit("#"), label)


def attribute_name(c: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as an underscore."""
    return F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_]", "_")


def attribute_label(name: Column) -> Column:
    return F.concat(F.lit("ss_"), F.substring(name, 1, 30))


def attribute_type(c: Column) -> Column:
    return F.when(c.isin("text", "category", "tags"), c).otherwise(F.lit("text"))


def restrict_expression(ids: Column) -> Column:
    """'id:a or id:b' over sorted distinct ids; empty for none."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.concat(F.lit("id:"), i.cast("string"))), " or ")
