"""Arrow batches inside tasks: cut to a bounded size, memory handed back."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of a batch that are turned into Python objects at once; these take many times as much.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, at most `limit` bytes at a time; a longer row is alone. Empty batches are left out."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > limit:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def freeing(work: Callable) -> Callable:
    """A function over Arrow batches that hands what it no longer uses back to the system when its task ends.

    Workers live on for later tasks and other operators; without this each keeps the largest amount it ever used."""

    @functools.wraps(work)
    def done(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                gc.collect()
                trim(0)

    return done
