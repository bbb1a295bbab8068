"""Document fingerprints: improbable-feature digests.

Every window of W bytes has an entropy, and by that a rarity: how improbable such an entropy is (PRIOR), where windows of
little entropy (runs, padding) count as least rare. Each stretch of W windows votes for its rarest; windows with
enough votes are the features. Their hashes fill a chain of Bloom filters, and the likeness of two chains is the overlap of
set bits, less what chance would give, as a share of what it could be. Texts with few features, short ones above all, also
get the rarest window of every stretch whatever its votes, so that all their bytes are under some feature. Votes depend on near bytes only, so equal
passages give equal features wherever they stand."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from glyphlake.llm.common import freeing, sliced

W = 64
VOTES = 16
#: Texts with fewer distinct features than FEW get more: windows of SMALL bytes below 2 * MIDDLE bytes, of W from MIDDLE on.
FEW, SMALL, MIDDLE = 8, 8, 512
#: Mean and deviation, in bits, of the entropy of W bytes of usual text; entropies below LEAST are no features.
PRIOR, LEAST = (3.7, 0.3), 2.0
FILTER_BITS, FILTER_ITEMS, HASHES = 2048, 160, 5
#: Windows that are worked on at once; a longer text goes in overlapping pieces, which give the same features.
PIECE = 1 << 18
#: Rows drawn for each range where ids are no numbers.
SAMPLED = 20

_SCALE = 1 << 24
_COUNTS = np.arange(W + 1, dtype=np.float64)
_WEIGHTS = np.round(_SCALE * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
_GAIN = np.append(np.diff(_WEIGHTS), 0)
_BASE, _FINAL = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


def window_entropies(data: np.ndarray) -> np.ndarray:
    """Bits of entropy of each window of W bytes, from exact counts: a byte that comes in or goes out changes the sum of
    c log c by what its count among the W - 1 bytes beside it says."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    keys = data[order].astype(np.int64) * (n + 2 * W) + order
    rank = np.arange(n)
    before = np.empty(n, np.int64)
    before[order] = rank - np.searchsorted(keys, keys - (W - 1))
    after = np.empty(n, np.int64)
    after[order] = np.searchsorted(keys, keys + (W - 1), side="right") - rank - 1
    # equal bytes of other values are never within reach: keys of one value lie more than W from any other's
    change = _GAIN[before].copy()
    first = change[:W].copy()
    # counts before a place that reach back to the start are exact as they are; from W on, one byte goes out first
    change[W:] -= _GAIN[after[:-W]]
    change[:W] = first
    total = np.cumsum(change)[W - 1 :]
    return np.log2(W) - total / (_SCALE * W)


def rarities(entropy: np.ndarray) -> np.ndarray:
    """0 to 1,000,000; larger is rarer. Windows below LEAST get 0."""
    far = np.abs(entropy - PRIOR[0]) / PRIOR[1]
    return np.where(entropy < LEAST, 0, np.minimum(1 + np.round(far * 60_000), 1_000_000)).astype(np.int64)


def window_hashes(data: np.ndarray, at: np.ndarray, width: int = W) -> np.ndarray:
    """64-bit hashes of the windows that begin at these places."""
    eight = np.lib.stride_tricks.sliding_window_view(data, width)[at].copy().view("<u8").reshape(len(at), width // 8)
    h = np.full(len(at), _FINAL, np.uint64)
    for k in range(width // 8):
        h = (h ^ eight[:, k]) * _BASE
        h ^= h >> np.uint64(29)
    h *= _FINAL
    return h ^ (h >> np.uint64(32))


def features(data: bytes) -> np.ndarray:
    """Hashes of a text's features, in order; where these are few, those of `covering` windows follow."""
    if not data:
        return np.zeros(0, np.uint64)
    whole = np.frombuffer(data, np.uint8)
    if len(whole) < SMALL:
        return np.array([int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")], np.uint64)
    found = [window_features(whole)] if len(whole) >= W else []
    if not found or len(found[0]) < FEW or len(np.unique(found[0])) < FEW:
        if len(whole) >= MIDDLE:
            found.append(window_features(whole, all_stretches=True))
        if len(whole) < 2 * MIDDLE:
            found.append(covering(whole))
    return np.concatenate(found)


def window_features(whole: np.ndarray, all_stretches: bool = False) -> np.ndarray:
    """Hashes of the windows with enough votes; or of every stretch's rarest, of equals that of least hash, and of the
    first and last window."""
    windows, found = len(whole) - W + 1, []
    for start in range(0, windows, PIECE):
        low, high = max(0, start - W), min(windows, start + PIECE + W)
        part = whole[low : high + W - 1]
        rare = rarities(window_entropies(part))
        n = len(rare)
        key = ((1_000_000 - rare) << 32) + np.arange(n)  # the rarest, and of equals the leftmost, is least
        if all_stretches:
            order = np.lexsort((window_hashes(part, np.arange(n)), -rare))
            key[order] = (np.arange(n) << 32) + order
        span = min(W, n)
        best, width = key, 1
        while width * 2 <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            best = np.minimum(best[: n - span + 1], best[span - width : span - width + n - span + 1])
        votes = np.bincount(best & 0xFFFFFFFF, minlength=n)
        if all_stretches:
            votes[0] += low == 0
            votes[-1] += high == windows
            at = np.flatnonzero(votes)
        else:
            at = np.flatnonzero((votes >= min(VOTES, n - span + 1)) & (rare > 0))
        at = at[(at + low >= start) & (at + low < start + PIECE)]
        found.append(window_hashes(part, at))
    return np.concatenate(found)


def covering(whole: np.ndarray) -> np.ndarray:
    """Hashes of windows of SMALL bytes: of each SMALL of them that with most distinct bytes, of equals that of least hash,
    and the first and the last. They leave no byte out."""
    n = len(whole) - SMALL + 1
    hashes = window_hashes(whole, np.arange(n), SMALL)
    bytes_ = np.sort(np.lib.stride_tricks.sliding_window_view(whole, SMALL), axis=1)
    distinct = (bytes_[:, 1:] != bytes_[:, :-1]).sum(1)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((hashes, -distinct))] = np.arange(n)
    span = min(SMALL, n)
    best = np.lib.stride_tricks.sliding_window_view(rank, span).argmin(1) + np.arange(n - span + 1)
    return hashes[np.unique(np.concatenate([best, [0, n - 1]]))]


def chain(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(items, bytes of the filter) for each FILTER_ITEMS distinct features, in the order in which they first come."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    out = []
    for start in range(0, len(hashes), FILTER_ITEMS):
        part = hashes[start : start + FILTER_ITEMS]
        bits = np.zeros(FILTER_BITS, np.uint8)
        for k in range(HASHES):
            bits[(part >> np.uint64(12 * k)) % np.uint64(FILTER_BITS)] = 1
        out.append((len(part), np.packbits(bits)))
    return out


def written(filters: list[tuple[int, np.ndarray]]) -> str:
    """A chain as text: items:base64, one after the other with semicolons; empty for an empty text."""
    return ";".join(f"{n}:{base64.b64encode(bits.tobytes()).decode()}" for n, bits in filters)


def fingerprint(text: str) -> str:
    return written(chain(features(text.encode())))


def parsed(text: str) -> np.ndarray:
    parts = [base64.b64decode(x.partition(":")[2]) for x in text.split(";") if x]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), FILTER_BITS // 8)


def likeness(a: str, b: str, rows: int = 256) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, weighted by set bits. Equal
    fingerprints score 1, an empty one 0 against any other. Filters are compared in blocks of bounded size."""
    if a == b:
        return 1.0
    x, y = sorted((parsed(a), parsed(b)), key=len)
    if not len(x):
        return 0.0
    if len(x) == len(y) and a > b:
        x, y = y, x
    by = np.unpackbits(y, axis=1).astype(np.float32)
    set_y, score, weight = by.sum(1), 0.0, 0.0
    for start in range(0, len(x), rows):
        bx = np.unpackbits(x[start : start + rows], axis=1).astype(np.float32)
        set_x = bx.sum(1)
        common = bx @ by.T
        chance = set_x[:, None] * set_y[None, :] / FILTER_BITS
        most = np.minimum(set_x[:, None], set_y[None, :])
        share = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
        score, weight = score + float((share * set_x).sum()), weight + float(set_x.sum())
    return score / weight


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; equal texts have equal fingerprints, null and empty texts an empty one. Null ids,
    ties and repeated rows keep their rows; empty tables give an empty result; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()])], names=[id_col, "fingerprint"])

    return rows.mapInArrow(freeing(made), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fingerprint string")


def bounds(docs: DataFrame, id_col: str, parts: int) -> list:
    """At most parts - 1 ids that cut the table into ranges of about equal numbers of rows: of numbers by counts over all
    rows, of other kinds by the ids of SAMPLED rows a range, drawn by a hash. Cuts only balance the work, any serve."""
    if parts < 2:
        return []
    if isinstance(docs.schema[id_col].dataType, NumericType):
        steps = [i / parts for i in range(1, parts)]
        return sorted(set(docs.agg(F.percentile_approx(id_col, F.lit(steps), F.lit(10 * parts)).alias("q")).first()["q"] or []))
    drawn = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col, F.monotonically_increasing_id()).alias("place"))
    ids = [r["id"] for r in drawn.orderBy("place").limit(SAMPLED * parts).orderBy("id").collect()]
    return list(dict.fromkeys(ids[len(ids) * i // parts] for i in range(1, parts) if len(ids) * i // parts > 0))


def in_ranges(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(range, id, text, own): rows by ranges of ids, range 0 the highest. The first rows of a range come also, with
    own false, at the end of the range before it; the first of all come at the end of the last, so that each row's
    next one is at hand. Null ids follow the lowest."""
    cuts = bounds(docs.select(id_col), id_col, parts)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.lit(len(cuts))
    if cuts:
        # ranges run downwards: the number of cuts at or above the id, found by halving
        def halve(low: int, high: int):
            if low == high:
                return F.lit(len(cuts) - low)
            mid = (low + high) // 2
            return F.when(F.col("id") <= F.lit(cuts[mid]), halve(low, mid)).otherwise(halve(mid + 1, high))

        place = F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(halve(0, len(cuts)))
    rows = rows.withColumn("range", place.cast("int"))
    heads = {r["range"]: r["head"] for r in rows.groupBy("range").agg(F.max("id").alias("head")).collect()}
    filled = sorted(heads)
    before = {heads[r]: filled[i - 1] for i, r in enumerate(filled)}  # head id -> range it is needed in as well
    if not before:
        return rows.select("range", "id", "text", F.lit(True).alias("own"))
    named = [(k, v) for k, v in before.items() if k is not None]
    lookup = rows.sparkSession.createDataFrame(named, f"head {rows.schema['id'].dataType.simpleString()}, also int")
    again = rows.join(F.broadcast(lookup), F.col("id") == F.col("head")).select(F.col("also").alias("range"), "id", "text", F.lit(False).alias("own"))
    if None in before:
        again = again.union(rows.where("id is null").select(F.lit(before[None]).alias("range"), "id", "text", F.lit(False)))
    return rows.select("range", "id", "text", F.lit(True).alias("own")).union(again)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Rows follow one another by descending id, null ids last, ties by text; the first follows the last, and a single
    row follows itself. Ids may be of any type that Spark can order. Null texts count as empty; very long ones are
    worked on in pieces that give the same features; repeated rows keep their rows. Texts are shuffled once, by ranges of
    ids whose number `parts` is (four for each shuffle partition unless given); empty tables give an empty result;
    other columns are ignored."""
    spark: SparkSession = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_ranges(docs, id_col, text_col, parts).repartition("range").sortWithinPartitions("range", F.desc("own"), F.desc_nulls_last("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text, fingerprint) of the row that waits for its next one
        for batch in sliced(batches, 2):
            out = []
            for part, key, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not own and (held is None or held[0] != part):
                    continue  # a further row of the same head
                mark = fingerprint(text)
                if held is not None and held[0] == part:
                    edit = edited_text(held[2], text)
                    other = held[3] if edit == held[2] else fingerprint(edit)
                    out.append((held[1], len(held[2]), edit, held[3], other, likeness(held[3], other), likeness(held[3], mark)))
                held = (part, key, text, mark) if own else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)

    return rows.select("range", "id", "text", "own").mapInArrow(freeing(made), f"`{id_col}` {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
