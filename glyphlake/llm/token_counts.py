"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import by_bytes, freeing, id_and_text, sliced

MODEL = "piece_bpe_32k.model"
BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 15
OVER = 4096


def model_file(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(MODEL)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, splits_at_spaces(model)


def splits_at_spaces(model) -> bool:
    """Whether counts add up over pieces of a text cut at a lone space between ASCII letters or digits.

    True if no piece has the space mark after another character, so that no merge crosses the cut, and if
    the model puts a space before a text by itself, so that a piece without its space gets it back."""
    inner = any("▁" in p.lstrip("▁") for p in (model.id_to_piece(i) for i in range(model.vocab_size())))
    probes = (("ab", "cd"), ("a", "1"), ("x9", "Zq"), ("in", "the"))
    return not inner and all(model.encode(f"{a} {b}") == model.encode(a) + model.encode(b) for a, b in probes)


def segments(text: str, limit: int) -> Iterator[str]:
    """Cuts text into pieces of about `limit` characters, each cut replacing one space between ASCII letters
    or digits; a stretch without such a place stays whole."""
    start = 0
    while len(text) - start > limit:
        at = start + limit
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = -1
                break
            before, after = text[at - 1], text[at + 1]
            if before.isascii() and before.isalnum() and after.isascii() and after.isalnum():
                break
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, batch_bytes: int = BATCH_BYTES, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text under a SentencePiece model.

    No begin or end tokens; special strings in a text are ordinary text, as is the library's default. Very long texts are
    cut where counts add up (see `splits_at_spaces`), so that a batch holds about batch_bytes bytes; a stretch without
    a lone space between ASCII letters or digits can't be cut safely and goes to the library whole. A null or empty
    text has 0 bytes and 0 tokens; null ids, repeated rows and ties each keep their row; an empty table gives an empty
    result; other columns are ignored."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, additive = _encoder(model_file(model_path))
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            totals = [0] * len(texts)
            cut = ((i, s) for i, t in enumerate(texts) if t for s in (segments(t, segment_chars) if additive else (t,)))
            for group in by_bytes(cut, batch_bytes):
                for (i, _), ids in zip(group, model.encode([s for _, s in group], num_threads=1), strict=True):
                    totals[i] += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length(text_col).cast("long"))
    return rows.mapInArrow(freeing(lengths), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")


def over_limit(counts: DataFrame, limit: int = OVER) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
