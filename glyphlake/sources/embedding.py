"""Embeddings from a service, or from a deterministic stand-in; both are callables over lists of texts."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphlake.settings import BAD_RESPONSE_RETRIES, HTTP_ATTEMPTS, EmbedSettings
from glyphlake.sources.readers import base_url

Embed = Callable[[Sequence[str]], list[list[float]]]


class EmbedError(Exception):
    """A service's answer that can't be used; `bad` has the places of the texts it failed for, ten at most."""

    def __init__(self, message: str, bad: Sequence[int] = ()):
        super().__init__(message)
        self.bad = tuple(bad[:10])


def is_vector(value) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) for x in value)


def checked(answer, count: int) -> list[list[float]]:
    """The vectors of an answer in the order of the texts; EmbedError if one is missing or no list of finite numbers."""
    data = answer.get("data") if isinstance(answer, dict) else None
    if not isinstance(data, list) or len(data) != count:
        raise EmbedError(f"{len(data) if isinstance(data, list) else 'no'} vectors for {count} texts")
    rows = sorted(enumerate(data), key=lambda x: x[1].get("index", x[0]) if isinstance(x[1], dict) else x[0])
    found = [r.get("embedding") if isinstance(r, dict) else None for _, r in rows]
    if bad := [i for i, v in enumerate(found) if not is_vector(v)]:
        raise EmbedError(f"unusable vectors at {bad[:10]}", bad)
    return found


@dataclass(frozen=True)
class Service:
    """POST base/v1/embeddings. Busy and failing servers and lost connections are tried again after growing pauses; other
    refusals fail at once; an unusable answer is asked for again without a pause."""

    settings: EmbedSettings
    sleep: Callable[[float], None] = time.sleep

    def post(self, texts: Sequence[str]):
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.settings.api_key}"} if self.settings.api_key else {})
        body = json.dumps({"model": self.settings.model, "input": list(texts)}).encode()
        for attempt in range(HTTP_ATTEMPTS):
            try:
                request = urllib.request.Request(f"{base_url(self.settings.base_url)}/v1/embeddings", body, headers)
                with urllib.request.urlopen(request, timeout=self.settings.timeout) as got:
                    return got.read()
            except urllib.error.HTTPError as e:
                again, why = e.code == 429 or e.code >= 500, f"HTTP {e.code}"
            except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
                again, why = True, str(e)
            if not again or attempt == HTTP_ATTEMPTS - 1:
                raise EmbedError(why)
            self.sleep(min(2**attempt, 30))

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        for left in range(BAD_RESPONSE_RETRIES, -1, -1):
            try:
                return checked(json.loads(self.post(texts)), len(texts))
            except (ValueError, EmbedError) as e:
                if not left or isinstance(e, EmbedError) and str(e).startswith("HTTP"):
                    raise e if isinstance(e, EmbedError) else EmbedError(str(e)) from e
        raise AssertionError


@dataclass(frozen=True)
class HashEmbedder:
    """Signed hashed words, brought to length 1: deterministic, without a service."""

    dim: int = 64

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()


def embed_all(embed: Embed, texts: Sequence[str], batch: int = 64, concurrency: int = 4, progress: Callable[[int, int], None] | None = None) -> list[list[float]]:
    """Vectors in the order of the texts, several batches at once."""
    parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
    out: list[list[float]] = []
    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        for got in pool.map(embed, parts):
            out += got
            if progress:
                progress(len(out), len(texts))
    return out


def embedded(chunks: DataFrame, embed: Embed, settings: EmbedSettings, text_col: str = "text") -> DataFrame:
    """chunks with a column vector. Batches of a task go out `concurrency` at a time; tasks run beside one another."""
    at = chunks.columns.index(text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = embed_all(embed, batch.column(at).to_pylist(), settings.batch_size, settings.concurrency)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=[*batch.schema.names, "vector"])

    return chunks.mapInArrow(made, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
