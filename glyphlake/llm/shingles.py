"""Word shingles as columns: A-Z lower-cased, words split at ASCII white space, five words a shingle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDTH = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), r"[\x20\x09-\x0D]+"), "")


def starts(ws: Column, width: int = WIDTH) -> Column:
    """Positions (from 0) at which shingles begin; one for a shorter text, none for an empty one."""
    last = F.greatest(F.size(ws) - width, F.lit(0))
    return F.when(F.size(ws) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def hashed(ws: Column, at: Column, width: int = WIDTH) -> Column:
    """64-bit hash of the shingle at this place; places past the end count as null, which a hash passes over."""
    return F.xxhash64(*[F.get(ws, at + k) for k in range(width)])


def spelled(ws: Column, width: int = WIDTH) -> Column:
    """The distinct shingles themselves, words joined by one space."""
    return F.array_distinct(F.transform(starts(ws, width), lambda i: F.array_join(F.slice(ws, i + 1, width), " ")))
