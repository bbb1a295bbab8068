"""Text codecs of stored chunks: zlib or zstandard with an optional dictionary, as binary columns. Parquet's own
compression serves tables of this engine; these are for exchange with stores that keep single compressed texts."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZLIB_LEVEL, ZSTD_LEVEL = 6, 3


@dataclass(frozen=True)
class Codec:
    """name 'zlib' or 'zstd'; a dictionary is for zstd alone. What was written with a codec is read with it: nothing is
    guessed from the bytes."""

    name: str = "zlib"
    dictionary: bytes = b""

    def __post_init__(self):
        if self.name not in ("zlib", "zstd"):
            raise ValueError(f"unknown codec {self.name}")

    def _zstd(self):
        import zstandard

        return zstandard, zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None

    def compress(self, text: str) -> bytes:
        if self.name == "zlib":
            return zlib.compress(text.encode(), ZLIB_LEVEL)
        zstandard, known = self._zstd()
        return zstandard.ZstdCompressor(level=ZSTD_LEVEL, dict_data=known).compress(text.encode())

    def decompress(self, data: bytes) -> str:
        if self.name == "zlib":
            return zlib.decompress(data).decode()
        zstandard, known = self._zstd()
        return zstandard.ZstdDecompressor(dict_data=known).decompress(data).decode()

    def spec(self) -> str:
        return json.dumps({"codec": self.name, "dictionary": self.dictionary.hex()})


def resolve(stored: str | None, wanted: Codec) -> tuple[Codec, bool]:
    """(codec to read with, whether a rewrite to `wanted` is due). A stored codec is the truth; one that is missing or
    can't be read is replaced by the wanted one."""
    try:
        found = json.loads(stored or "")
        codec = Codec(found["codec"], bytes.fromhex(found.get("dictionary", "")))
    except (ValueError, KeyError, TypeError):
        return wanted, False
    return codec, codec != wanted


def compress_column(c: Column, codec: Codec) -> Column:
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else codec.compress(t))

    return packed(c)


def decompress_column(c: Column, codec: Codec) -> Column:
    @F.pandas_udf("string")
    def unpacked(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else codec.decompress(b))

    return unpacked(c)


def recompress_column(c: Column, old: Codec, new: Codec) -> Column:
    """Blobs of one codec as those of another; one that can't be read fails the job, so that nothing is half converted."""

    @F.pandas_udf("binary")
    def moved(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else new.compress(old.decompress(b)))

    return c if old == new else moved(c)


def train_dictionary(samples: Iterable[str], size: int = 16_384) -> bytes:
    """A zstandard dictionary from a bounded sample of texts that the caller chooses."""
    import zstandard

    return zstandard.train_dictionary(size, [s.encode() for s in samples]).as_bytes()
