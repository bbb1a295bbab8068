"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

Entities that the base patterns find are seeds. Lexical patterns are the two words before the word that holds an entity, or
the two words behind it. One pass over the texts gives the graph: which patterns stand by which instances, where an
instance is a base entity or anything that looks like an identifier. A second pass counts how often the words of a
pattern stand anywhere; a filter of bounded size picks them out, so that it is one pass however many patterns there are.
Then Spark scores the graph in rounds. A pattern's score is the share of its occurrences that stand by known instances,
each by its worth: seeds count 1, others what their best accepted pattern scored in the round before, times DECAY. A pattern is
accepted from CONFIDENCE on if at least MIN_SEEDS different known instances speak for it. What accepted patterns stand by
becomes known and induces patterns in the next round. Frequent words that happen to stand by an entity get a low
share and discover nothing."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import setsketch as sk
from glyphlake.llm.common import WORD, drop_saved, freeing, id_and_text, save, sliced, small_batches, split_join
from glyphlake.llm.secret_scan import SPANS

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "context")

#: Fixed patterns of the base kinds. An email is found from its @, and an address of numbers begins where no digit stands
#: before it (from a later digit of a run it can't match if it can't from the first), so that any text takes linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Known instances that a pattern must have, its least share, patterns held by a worker at once.
MIN_SEEDS, CONFIDENCE, BLOCK = 3, 0.6, 200_000
#: Rounds end when no score grows by more than this, all scores together.
STILL = 1e-6
#: An instance found by a pattern is worth this much of the pattern's share.
DECAY = 0.9
TOKEN, BLANK = re.compile(WORD), frozenset(" \t\n\v\f\r")
#: What is called an identifier is no longer than this. Words of more bytes stand in patterns by their hash. Words around an
#: instance are first looked for so many characters to either side, then twice as far, until they are found.
IDENTIFIER_CHARS, WORD_BYTES, REACH = 128, 64, 256
LONG_WORD = re.compile(rb"(?<!\S)\S{%d,}" % (WORD_BYTES + 1))
#: What may be inside an identifier, where one shows, and how many digits make one by themselves.
INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/@-")
MARK = re.compile(r"[0-9]|[A-Za-z0-9][_@.][A-Za-z0-9]|[a-z][A-Z]")
REST = re.compile(r"[A-Za-z0-9._/@-]*")
LETTERS, JOINT = re.compile("[A-Za-z]"), re.compile("[A-Za-z0-9][_@.][A-Za-z0-9]|[a-z][A-Z]")
MIN_DIGITS = 4
#: Bytes of text whose pairs of words are hashed at once; bits of the filter for each pattern, and its least and most bits.
SLICE_BYTES, FILTER_BITS, FILTER_LEAST, FILTER_MOST = 1 << 18, 64, 1 << 16, 1 << 28

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """As [A-Za-z0-9._%+-]+ before DOMAIN would match, leftmost and without overlaps."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            yield "email", start, m.end()
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """The base kinds by kind as in KINDS, then start; matches that fail a test are dropped."""
    out = list(emails(text)) if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))


def plain(text: str) -> bytes:
    """Lower case, every digit as 0, long words as a hash of that."""
    flat = text.lower().encode().translate(DIGITS)
    return LONG_WORD.sub(_hashed, flat) if len(flat) > WORD_BYTES else flat


def _hashed(word: re.Match) -> bytes:
    return b"#" + hashlib.blake2b(word[0], digest_size=16).hexdigest().encode()


def identifiers(text: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """What looks like an identifier between these places: a run of letters, digits and inner joints that has at least
    MIN_DIGITS digits, or letters around an underscore, an at, a dot or a change from small letters to capitals."""
    stop, floor = len(text) if stop is None else stop, start
    while (m := MARK.search(text, floor, stop)) is not None:
        low, high = m.start(), REST.match(text, m.start(), stop).end()
        while low > floor and text[low - 1] in INNER:
            low -= 1
        floor = high
        while low < high and text[low] in "._/@-":
            low += 1
        while high > low and text[high - 1] in "._/@-":
            high -= 1
        run = text[low:high]
        if len(run) <= IDENTIFIER_CHARS and (sum(c.isdigit() for c in run) >= MIN_DIGITS or len(run) >= MIN_DIGITS and LETTERS.search(run) and JOINT.search(run)):
            yield low, high


def found_instances(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is a base entity) of all instances in order; those that touch a base entity don't count."""
    base = sorted((s, e) for _, s, e in base_spans(text))
    starts, ends = [s for s, _ in base], np.maximum.accumulate([e for _, e in base]).tolist() if base else []
    out = [(s, e, True) for s, e in base]
    for s, e in identifiers(text):
        k = bisect_right(starts, e - 1)
        if not k or ends[k - 1] <= s:
            out.append((s, e, False))
    return sorted(out)


def before(text: str, at: int) -> str | None:
    """The two words before the word that this place is in, as a pattern."""
    reach = REACH
    while True:
        low = max(0, at - reach)
        words = TOKEN.findall(text, low, at)
        cut = low and text[low - 1] not in BLANK and text[low] not in BLANK
        if words and text[at - 1] not in BLANK:
            words.pop()
        words = words[1:] if cut else words
        if len(words) > 1:
            return f"{pair(*words[-2:])}\t"
        if not low:
            return None
        reach *= 2


def behind(text: str, at: int) -> str | None:
    """The two words behind the word that ends, or goes on, at this place, as a pattern."""
    reach = REACH
    while True:
        high = min(len(text), at + reach)
        words = TOKEN.findall(text, at, high)
        cut = high < len(text) and text[high] not in BLANK and text[high - 1] not in BLANK
        if words and text[at] not in BLANK:
            words = words[1:]
        words = words[:-1] if cut else words
        if len(words) > 1:
            return f"\t{pair(*words[:2])}"
        if high == len(text):
            return None
        reach *= 2


def pair(a: str, b: str) -> str:
    return f"{plain(a).decode()} {plain(b).decode()}"


def edges_of(text: str) -> Iterator[tuple[str, str, bool]]:
    """(pattern, instance, seed) around every instance; of several in one word the first has the words before it, the
    last those behind it."""
    found = found_instances(text)
    for k, (s, e, seed) in enumerate(found):
        if (not k or not _same_word(text, found[k - 1][1], s)) and (p := before(text, s)):
            yield p, text[s:e], seed
        if (k + 1 == len(found) or not _same_word(text, e, found[k + 1][0])) and (p := behind(text, e)):
            yield p, text[s:e], seed


def _same_word(text: str, end: int, start: int) -> bool:
    return start <= end or not SPACE.search(text, end, start)


SPACE = re.compile(r"[\x20\x09-\x0D]")


def matches(text: str, patterns: frozenset[str], words: frozenset[bytes]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether the words stand before it) of the words that these patterns stand by. `words` are the first
    words of patterns; places are worked out only where there is a hit."""
    flat = plain(text).split()
    hits = [(i, w) for i in range(len(flat) - 1) if flat[i] in words for w in (f"{flat[i].decode()} {flat[i + 1].decode()}",) if f"{w}\t" in patterns or f"\t{w}" in patterns]
    if hits:
        at = [m.span() for m in TOKEN.finditer(text)]
        for i, w in hits:
            if f"{w}\t" in patterns and i + 2 < len(at):
                yield *at[i + 2], True
            if f"\t{w}" in patterns and i:
                yield *at[i - 1], False


def context_spans(text: str, base: Iterable[Span], patterns: frozenset[str], words: frozenset[bytes]) -> list[Span]:
    taken = sorted((s, e) for _, s, e in base)
    starts, ends = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    out = set()
    for start, end, first in matches(text, patterns, words):
        runs = list(identifiers(text, start, end))
        if runs:
            s, e = runs[0 if first else -1]
            k = bisect_right(starts, e - 1)
            if not k or ends[k - 1] <= s:
                out.add(("context", s, e))
    return sorted(out, key=lambda s: s[1])


def graph(rows: DataFrame, flush: int = 50_000) -> DataFrame:
    """(pattern, instance, seed, n) over all texts, summed in each task first, with bounded memory."""
    names = ["pattern", "instance", "seed", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], names=names)
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(1):
                seen.update(edges_of(text.as_py()))
                if len(seen) >= flush:
                    yield out()
        yield out()

    found = rows.mapInArrow(freeing(count), "pattern string, instance string, seed boolean, n long")
    return found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))


def pair_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of all neighbouring words."""
    hashes = sk.word_hashes(np.frombuffer(data, np.uint8))[1]
    return sk.mixed(hashes[:-1] * sk._M + hashes[1:])


def pattern_filter(patterns: DataFrame, count: int) -> np.ndarray:
    """A filter of the patterns' words, of at most FILTER_MOST bits, as bytes: a bit for each hash, collected in parts."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_BITS * count - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pair_hashes("\n".join(p.strip("\t") for p in batch.column(0).to_pylist()).encode())[::2]
                yield pa.RecordBatch.from_arrays([pa.array((found % np.uint64(bits)).astype(np.int64))], names=["place"])

    part = 1 << 15
    marked = patterns.select("pattern").mapInArrow(places, "place long").groupBy(F.floor(F.col("place") / part).alias("part")).agg(F.bitmap_construct_agg(F.col("place") % part).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in marked.collect():
        out[row["part"] * part // 8 : (row["part"] + 1) * part // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def word_pairs(rows: DataFrame, marks: np.ndarray, flush: int = 50_000) -> DataFrame:
    """(pair, total): how often each pair of words that passes the filter stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([f"{a.decode()} {b.decode()}" for a, b in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])
            seen.clear()
            return made

        for batch in sliced(batches, limit=SLICE_BYTES):
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            found = pair_hashes(b"\n".join(texts)) % np.uint64(8 * len(marks))
            hits = np.flatnonzero((marks[found >> np.uint64(3)] >> (found & np.uint64(7)).astype(np.uint8)) & 1)
            if len(hits):
                words, last = [], []
                for t in texts:
                    words += t.split()
                    last.append(len(words) - 1)
                ends = set(last)
                seen.update((words[i], words[i + 1]) for i in hits.tolist() if i not in ends)
            if len(seen) >= flush:
                yield out()
        yield out()

    return rows.mapInArrow(freeing(count), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("total"))


def bootstrap(edges: DataFrame, patterns: DataFrame, instances: DataFrame, min_seeds: int, confidence: float, rounds: int | None) -> DataFrame:
    """(pattern, score) of the patterns that are accepted in the last round.

    edges: (pattern, instance, n); patterns: (pattern, total, weight); instances: (instance, seed, weight), where weights
    count edges. Rounds end when accepted patterns, known instances and scores stay the same: what is known only grows from
    round to round, so scores only rise, and what one pattern hands on to the next is less by DECAY each time."""
    known, before_ = instances.where("seed").select("instance", F.lit(1.0).alias("worth"), "weight"), None
    accepted, held = None, []
    for _ in count() if rounds is None else range(rounds):
        support = split_join(edges, known, "instance", "weight").groupBy("pattern").agg(F.sum(F.col("n") * F.col("worth")).alias("hits"), F.count("*").alias("known"))
        scored = support.where(F.col("known") >= min_seeds).join(patterns, "pattern").withColumn("score", F.least(F.lit(1.0), F.col("hits") / F.col("total")))
        accepted = save(scored.where(F.col("score") >= confidence).select("pattern", "score", "weight"), "pii-accepted")
        found = split_join(edges, accepted, "pattern", "weight").groupBy("instance").agg((F.max("score") * DECAY).alias("found"))
        known = instances.join(found, "instance", "left").where("seed or found is not null").select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("found")).alias("worth"), "weight")
        known = save(known, "pii-known")
        drop_saved(*held)
        held = [accepted, known]
        now = (*accepted.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first(), known.count())
        if not now[0] or before_ and now[0] == before_[0] and now[2] == before_[2] and now[1] - before_[1] <= STILL:
            break
        before_ = now
    result = save(accepted.select("pattern", "score"), "pii-patterns")
    drop_saved(*held)
    return result


def _blocks(patterns: DataFrame, size: int) -> Iterator[frozenset[str]]:
    """Patterns in blocks of bounded size, each small enough for a worker; all of them come."""
    block: set[str] = set()
    for row in patterns.toLocalIterator():
        block.add(row["pattern"])
        if len(block) >= size:
            yield frozenset(block)
            block = set()
    if block:
        yield frozenset(block)


def _firsts(patterns: Iterable[str]) -> frozenset[bytes]:
    return frozenset(p.strip("\t").split(" ")[0].encode() for p in patterns)


def learn_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """(pattern, score) of the accepted patterns over all texts; a pattern is two words with a tab where the instance
    stands. Rounds go on until nothing changes, unless `rounds` says how many. Empty tables and tables without entities give
    no pattern."""
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    whole = save(graph(rows), "pii-graph")
    stats = save(whole.groupBy("pattern").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_seeds), "pii-candidates")
    candidates = stats.count() if not whole.where("seed").isEmpty() else 0
    if not candidates:
        drop_saved(whole, stats)
        return docs.sparkSession.createDataFrame([], "pattern string, score double")
    totals = word_pairs(rows, pattern_filter(stats, candidates))
    patterns = save(stats.withColumn("pair", F.translate("pattern", "\t", "")).join(totals, "pair").select("pattern", "total", "weight"), "pii-totals")
    edges = save(split_join(whole, stats, "pattern", "weight"), "pii-edges")
    instances = save(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.count("*").alias("weight")), "pii-instances")
    found = bootstrap(edges.select("pattern", "instance", "n"), patterns, instances, min_seeds, confidence, rounds)
    drop_saved(whole, stats, patterns, edges, instances)
    return found


def annotate(rows: DataFrame, id_col: str, text_col: str, patterns: frozenset[str], first: bool) -> DataFrame:
    """Adds what one block of patterns finds to the spans of (id, text, spans); the first block adds the base kinds."""
    firsts = _firsts(patterns)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, had in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = base_spans(text) if first else [(s["kind"], s["start"], s["end"]) for s in had]
                if patterns:
                    spans = in_order(spans + context_spans(text, spans, patterns, firsts))
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kind)], names=[id_col, text_col, "spans"])

    return rows.mapInArrow(freeing(found), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{text_col}` string, spans {SPANS}")


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """(id, text, spans) of every row: the base kinds, then what patterns discover (kind context), by kind, then start.

    Spans are in code points, their end exclusive. Null and empty texts have none; very long texts are searched whole, in
    linear time; null ids, ties and repeated rows keep their rows; empty tables give an empty result; other columns are
    ignored. Accepted patterns are handed to workers in blocks of bounded size, one after the other; nearly always there
    is one block or none."""
    rows = id_and_text(docs, id_col, text_col).withColumn("spans", F.expr(f"cast(array() as {SPANS})"))
    first = True
    for patterns in _blocks(learn_patterns(docs, id_col, text_col, min_seeds, confidence), block):
        rows = annotate(rows if first else save(rows, "pii-spans"), id_col, text_col, patterns, first)
        first = False
    return annotate(rows, id_col, text_col, frozenset(), True) if first else rows


def redact_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK, **options) -> DataFrame:
    """The same columns and rows with every span of personal data replaced by its kind in brackets; null texts become
    empty. Very long texts are redacted whole; null ids, ties and repeated rows keep their rows; empty tables give an
    empty result; other columns, whatever their names, stay as they are. Patterns are learnt from all rows first, and
    beyond one block of them are applied block after block."""
    at, out, first = docs.columns.index(text_col), docs, True

    def step(patterns: frozenset[str]):
        firsts = _firsts(patterns)

        def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, at):
                texts = []
                for text in batch.column(at).to_pylist():
                    spans = base_spans(text or "")
                    if patterns:
                        spans = spans + context_spans(text or "", spans, patterns, firsts)
                    texts.append(redact(text or "", spans) if spans else text or "")
                columns = list(batch.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return redacted

    for patterns in _blocks(learn_patterns(docs, id_col, text_col, **options), block):
        out = (out if first else save(out, "pii-redacted")).mapInArrow(freeing(step(patterns)), docs.schema)
        first = False
    return out.mapInArrow(freeing(step(frozenset())), docs.schema) if first else out


def redact(text: str, spans: Iterable[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longest."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])
