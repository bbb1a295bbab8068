"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

The features are densities of a lexicon, how near its words stand to the second person, capitals, punctuation and rates
of obfuscation. The lexicon has fixed words and those that labelled texts induce: words, and beginnings of words (for
inflected languages), that stand in far more toxic texts than others. It is learnt, like the trees and the calibration,
on a bounded sample of labelled rows (TRAIN_ROWS); scoring covers all rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.boosting import Boosted, Isotonic, fit, isotonic
from glyphlake.llm.common import drop_saved, freeing, id_and_text, save, sliced, small_batches

#: Labelled rows that a model is fitted on at most, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
#: Log odds, share of toxic texts and number of texts that a term of the induced lexicon needs at least.
ODDS, SHARE, TEXTS = 2.5, 0.004, 6
THRESHOLD = 0.3

#: Fixed words: insults that the lexicon starts with, and pronouns of the second person.
INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool imbecile cretin garbage filth vermin bastard bitch asshole retard freak jerk ugly dummkopf idiota imbécil estúpido connard abruti crétin arschloch trottel".split())
SECOND = frozenset("you your yours yourself you're youre ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
LEET = str.maketrans("013457@$!", "oieastasi")
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…¡¿–—"
SPACED = re.compile(r"(?<!\w)\w(?:[ ._*-]\w){3,}(?!\w)")
RUNS = re.compile(r"(\w)\1{2,}")
HEADS = (4, 5, 6)
NEAR = 5
FEATURES = ("hits", "distinct", "hit_rate", "weight", "top", "near_second", "second_rate", "obfuscated_hits", "obfuscated_rate", "capital_rate", "exclaim_rate", "question_rate", "symbol_rate", "digit_rate", "long_runs", "log_words", "word_length")


def terms(word: str) -> Iterator[str]:
    """A word, marked as whole, and its beginnings."""
    yield f"{word}$"
    for n in HEADS:
        if len(word) >= n:
            yield word[:n]


class Lexicon:
    def __init__(self, weights: dict[str, float]):
        self.weights = {f"{w}$": 4.0 for w in INSULTS} | weights
        self.starts = frozenset(t.rstrip("$")[: HEADS[0]] for t in self.weights)

    def weight(self, word: str) -> tuple[float, str]:
        """The weight of the longest term that fits this word, and the term."""
        if word[: HEADS[0]] in self.starts:
            for term in (f"{word}$", *(word[:n] for n in reversed(HEADS) if len(word) >= n)):
                if (found := self.weights.get(term)) is not None:
                    return found, term
        return 0.0, ""


CLASSES = np.zeros(256, np.int64)
for _i, _group in enumerate((range(65, 91), b"!", b"?", b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~", range(48, 58)), 1):
    CLASSES[list(_group)] = _i


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of FEATURES; all 0 for an empty one."""
    words = [w.strip(STRIP) for w in text.lower().split()]
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    starts = lexicon.starts
    at: list[int] = []
    seen: dict[str, float] = {}
    hidden = odd = 0
    for i, w in enumerate(words):
        weight = 0.0
        if w[:4] in starts:
            weight, term = lexicon.weight(w)
        if not weight and not w.isalpha() and w and not w.isdigit():
            odd += 1
            plain = RUNS.sub(r"\1", re.sub(r"[^\w]|_", "", w.translate(LEET)))
            if plain[:4] in starts:
                weight, term = lexicon.weight(plain)
                hidden += bool(weight)
        if weight:
            at.append(i)
            seen[term] = weight
    if any(len(w) == 1 for w in words) or "." in text:
        for m in SPACED.finditer(text.lower()):
            weight, term = lexicon.weight(re.sub(r"[ ._*-]", "", m[0]).translate(LEET))
            if weight:
                hidden += 1
                seen[term] = weight
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(CLASSES[data], minlength=6) / len(data)
    hits = len(at) + hidden
    return [hits, len(seen), hits / n, sum(seen.values()), max(seen.values(), default=0.0), near, len(second) / n, hidden, odd / n, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], len(RUNS.findall(text)) / n, math.log1p(n), len(text) / n]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None
    calibration: Isotonic | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.raw(x)) if self.trees is not None else np.full(len(x), self.prior)


def held_out(id_col: str) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def copy_key(text: str) -> int:
    """The least hash of a text's runs of three words, which copies and near copies mostly share."""
    import xxhash

    words = text.lower().split()
    least = min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)
    return least - (1 << 64) if least >> 63 else least


def copies_once(sample: DataFrame) -> DataFrame:
    """(toxic, text): of the rows of one label and one `copy_key`, over the whole sample, the one of least id and text. So a
    group of copies counts once, however the rows are dealt; a text that only shares its least run counts with them."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([copy_key(t) for t in batch.column(2).to_pylist()], pa.int64())], names=["id", "toxic", "text", "key"])

    rows = sample.select("id", "toxic", "text")
    named = rows.mapInArrow(freeing(keyed), f"id {rows.schema[0].dataType.simpleString()}, toxic int, text string, key long")
    return named.groupBy("toxic", "key").agg(F.min_by("text", F.struct("id", "text")).alias("text")).select("toxic", "text")


def induce(train: DataFrame) -> dict[str, float]:
    """Terms with log odds: texts that hold a term, toxic or not, are counted in each task first, then over all. Every term
    that passes is taken; the size of the sample bounds their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts = (Counter(), Counter())
        for batch in sliced(batches):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w.strip(STRIP) for w in text.lower().split()}
                counts[toxic].update({t for w in words if len(w) > 2 for t in terms(w)})
                counts[toxic][""] += 1
        for toxic in (0, 1):
            keys = list(counts[toxic])
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                n = [counts[toxic][k] for k in part]
                zeros = [0] * len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n if toxic else zeros, pa.int64()), pa.array(zeros if toxic else n, pa.int64())], names=["term", "toxic", "clean"])

    counted = copies_once(train).mapInArrow(freeing(count), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = save(counted.where(f"toxic >= {TEXTS} or term = ''"), "toxic-terms")
    total = counted.where("term = ''").agg(F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1]:
        drop_saved(counted)
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total[0] + 1.0)) - F.log((F.col("clean") + 0.5) / (total[1] + 1.0))
    chosen = counted.where(f"term <> '' and toxic >= {SHARE * total[0]}").withColumn("odds", odds).where(f"odds >= {ODDS}")
    found = {r.term: float(r.odds) for r in chosen.orderBy("term").collect()}
    drop_saved(counted)
    return found


def _featured(rows: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(lexicon)
        for batch in sliced(batches, len(keep)):
            x = [features(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(freeing(made), f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from at most `rows` labelled rows outside the held-out part, the same however the rows are dealt.

    Rows of one id and equal text count once; of the others those of the least hashes of id and text are taken, so an id that
    many rows share brings no more than `rows` either. Null ids and labels, ids without a label and ids with several (of
    which the highest counts once) are no obstacle; copies under several ids each count in the trees, once in the lexicon;
    null texts count as empty, very long ones are read whole. Without rows of both classes, as from empty tables, the share of toxic ones is every score. Other columns are
    ignored."""
    small_batches(docs.sparkSession)
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(labelled.orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = id_and_text(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled_rows = texts.join(chosen, "id").withColumn("place", F.xxhash64("text"))
    keys = F.broadcast(labelled_rows.select("id", "place").distinct().orderBy(F.xxhash64("id", "place"), "id", "place").limit(rows))
    sample = save(labelled_rows.join(keys, ["id", "place"]).dropDuplicates(["id", "place"]), "toxic-sample")
    lexicon = induce(sample)
    parted = sample.select("id", "text", "toxic", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)).cast("int").alias("part"), "place")
    found = _featured(parted, lexicon, ["id", "toxic", "part", "place"]).orderBy("id", "place").collect()
    drop_saved(sample)
    y = np.array([r.toxic for r in found], float)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x, part = np.array([r.x for r in found]), np.array([r.part for r in found])
    fitted, rest = part != 0, part == 0
    if len(set(y[fitted].tolist())) < 2 or len(set(y[rest].tolist())) < 2:
        fitted = rest = np.full(len(y), True)
    trees = fit(x[fitted], y[fitted])
    return Model(lexicon, trees, isotonic(trees.raw(x[rest]), y[rest]), float(y.mean()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from its text alone. Null and empty texts get the score of a text without words; very long
    texts are read whole; null ids, ties and repeated rows keep their rows; empty tables give an empty result; other
    columns are ignored."""
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(model.lexicon)
        for batch in sliced(batches):
            x = np.array([features(t, words) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=[id_col, "score"])

    return rows.mapInArrow(freeing(scored), schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns, whatever their names. Null texts are scored as
    empty ones; a row's id plays no part; empty tables give an empty result."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(model.lexicon)
        for batch in sliced(batches, at):
            x = np.array([features(t or "", words) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(freeing(kept), docs.schema)


def judged(scores: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    return scores.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
