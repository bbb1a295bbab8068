"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is the result of merging by rank exactly if every two neighbours are the result of merging their
own joined bytes. So a text is cut into longest matches, and where a match can't stand beside its predecessor the next
shorter one is tried, or the predecessor taken back. Which ends were tried is kept in a list of flags, so no end is
tried twice and the work is linear in the text. Which tokens may be neighbours is worked out once and kept."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import freeing, id_and_text, sliced, small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries of each of the two generations of the cache of encoded pieces, and of the cache of neighbours, in a worker; bounds
#: on memory only.
CACHE, NEIGHBOURS = 40_000, 250_000
#: Bytes of text, or of ids, that are worked on at once.
SLICE_BYTES = 1 << 20


def ranks_file(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(RANKS)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: again and again join the leftmost neighbours of least rank. For short strings."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class PieceEncoder:
    """Encodes one piece of pre-split text; keeps pieces it has met in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE):
        import ahocorasick

        self.ranks = ranks
        self.names = {rank: token.decode("latin-1") for token, rank in ranks.items()}
        self.by_name = {name: rank for rank, name in self.names.items()}
        self.found = ahocorasick.Automaton()
        for name, rank in self.by_name.items():
            self.found.add_word(name, (len(name), rank))
        self.found.make_automaton()
        self.neighbours: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(64)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache = cache

    def forget(self) -> None:
        """Drops the pieces it has met: workers live on for other operators, which have no use for them."""
        self.young, self.old = {}, {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives these two tokens again; left is -1 at the start of a piece."""
        key = (left << 32) + right
        known = self.neighbours.get(key)
        if known is None:
            pair = [right] if left < 0 else [left, right]
            if len(self.neighbours) >= NEIGHBOURS:
                self.neighbours.clear()
            known = self.neighbours[key] = merge_by_rank("".join(self.names[t] for t in pair).encode("latin-1"), self.ranks) == pair
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for single bytes."""
        known = self.shorter.get(token)
        if known is None:
            name = self.names[token]
            known = self.shorter[token] = next((self.by_name[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.by_name), -1)
        return known

    def encode(self, data: str) -> list[int]:
        """Ids of a piece given as Latin-1 characters, one a byte."""
        if (whole := self.by_name.get(data)) is not None:
            return [whole]
        out, left, known, at = [], -1, self.neighbours, 0
        for end, (size, token) in self.found.iter_long(data):
            if end + 1 - size != at:
                break
            at = end + 1
            if not (known.get((left << 32) + token) or self.compatible(left, token)):
                return self.backtrack(data, out, at - size, token)
            out.append(token)
            left = token
        if at != len(data):
            raise ValueError("these ranks don't cover every byte")
        return out

    def longest(self, data: str, at: int) -> int:
        """The longest token that begins here."""
        found = next(self.found.iter_long(data, at), None)
        if found is None or found[0] + 1 - found[1][0] != at:
            raise ValueError("these ranks don't cover every byte")
        return found[1][1]

    def backtrack(self, data: str, out: list[int], at: int, token: int) -> list[int]:
        """Goes on from the tokens so far, with `token` the longest match at the place they reach."""
        names, size = self.names, len(data)
        open_end = bytearray(b"\1") * (size + 1)
        while at < size:
            left = out[-1] if out else -1
            while token >= 0:
                end = at + len(names[token])
                if open_end[end] and self.compatible(left, token):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = self.longest(data, at) if at < size else -1
            else:
                if not out:
                    raise ValueError("these ranks don't cover every byte")
                open_end[at] = 0
                back = out.pop()
                at -= len(names[back])
                token = self.next_shorter(back)
        return out

    def __call__(self, piece: str) -> bytes:
        """Ids of a piece of text as little-endian unsigned 32-bit integers."""
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                ids = self.encode(piece if piece.isascii() else piece.encode("utf-8").decode("latin-1"))
                got = self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self.young) >= self.cache:
                    self.young, self.old = {}, self.young
                self.young[piece] = got
        return got


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(read_ranks(path))


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_text(text: str, encoder: PieceEncoder, splitter) -> bytes:
    young, miss = encoder.young, encoder
    return b"".join([young.get(p) or miss(p) for p in splitter(text)])


def _ids(batch: pa.RecordBatch, ranks_path: str | None, pattern: str | None) -> list[bytes]:
    import public_tokenizers
    import regex

    encoder = _encoder(ranks_file(ranks_path))
    splitter = regex.compile(pattern or public_tokenizers.PATTERN).findall
    return [encode_text(t, encoder, splitter) for t in batch.column(1).to_pylist()]


def _bytes(ids: list[bytes | None], ranks_path: str | None) -> list[bytes]:
    import numpy as np

    tokens = _tokens(ranks_file(ranks_path))
    return [b"".join([tokens[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in ids]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, decode: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every row's whole text; ids are little-endian unsigned 32-bit integers in one binary. With
    decode also what these ids stand for, as `decode_documents` gives it, from the same worker.

    Each match of the pattern is encoded by itself, without special tokens, in time linear in its length; very long texts
    are encoded whole. Ranks that lack a byte of a text raise. A null or empty text has no ids; null ids, ties and
    repeated rows keep their rows; an empty table gives an empty result; other columns are ignored."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in sliced(batches, limit=SLICE_BYTES):
                ids = _ids(batch, ranks_path, pattern)
                more = [pa.array(_bytes(ids, ranks_path), pa.binary())] if decode else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *more], names=[id_col, "n_tokens", "ids", *["decoded"] * decode])
        finally:
            _encoder(ranks_file(ranks_path)).forget()

    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(freeing(encoded), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary{', decoded binary' * decode}")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ranks_path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids, decoded) with the bytes that `ids` stand for; unknown ids raise, null ids give no bytes."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, SLICE_BYTES):
            texts = _bytes(batch.column(2).to_pylist(), ranks_path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])

    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(id_col), "n_tokens", "ids")
    return rows.mapInArrow(freeing(decoded), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
