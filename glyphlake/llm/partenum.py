"""PartEnum signatures of shingle sets.

Sets of similar size are in one band. Two sets of a band, or of neighbouring ones, with a Jaccard similarity of at least
percent % differ in at most k features, where k follows from the band. The feature domain is dealt into n parts, and each part into
three pieces; a signature stands for what a set has in two pieces of a part. At most k / 2 parts can hold differences in two
pieces or more, so of more parts than that one has two pieces in which both sets are equal: similar sets share a
signature, always.

Pieces in which a set has nothing would make all such sets meet. Their signatures are left out, and to lose nothing there are
some parts to spare: a set for which more parts have an empty pair of pieces than there are to spare is dealt out again with
another seed, until a seed serves (or the last one, whose empty pairs count). Two sets share all seeds up to the first that
serves either of them, and there they meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from glyphlake.llm.setsketch import mixed

PIECES = 3
SEEDS = 8
#: One part to spare for so many parts that can be broken.
SPARE = 16


@dataclass(frozen=True)
class Instance:
    """What is done with the sets of band `at` and the one below."""

    at: int
    most: int  # size of a set, in features
    parts: int
    spare: int


def instances(percent: int) -> Iterator[Instance]:
    """The bands' instances by size, without end; parts is 0 where only equal sets are similar."""
    least, at = 1, 0
    while True:
        most = least * 100 // percent
        broken = 2 * most * (100 - percent) // (100 + percent) // 2
        spare = broken // SPARE
        yield Instance(at, most, broken + 1 + spare if 2 * most * (100 - percent) // (100 + percent) else 0, spare)
        least, at = most + 1, at + 1


class Bands:
    """Instances up to the largest set seen so far."""

    def __init__(self, percent: int):
        self.source, self.known = instances(percent), []

    def of(self, n: int) -> tuple[Instance, Instance]:
        """Both instances that a set of n features takes part in: its band's and the next."""
        while len(self.known) < 2 or self.known[-2].most < n:
            self.known.append(next(self.source))
        at = next(i for i in range(len(self.known)) if self.known[i].most >= n) if n <= self.known[-2].most else len(self.known) - 1
        return self.known[at], self.known[at + 1]


def dealt(features: np.ndarray, instance: Instance, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, whether they stand for anything), one row for each part: that of all pieces but the first, second, third."""
    salt = mixed(np.array([(instance.at << 8) + seed + 1], np.uint64))
    spread = mixed(features ^ salt)
    cells = PIECES * instance.parts
    cell = ((spread >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(cells, np.uint64)
    np.add.at(sums, cell, mixed(spread))
    sums = sums.reshape(-1, PIECES)
    counts = np.bincount(cell, minlength=cells).reshape(-1, PIECES)
    place = mixed(np.arange(cells, dtype=np.uint64) ^ salt).reshape(-1, PIECES)
    signatures = mixed((sums.sum(1, keepdims=True, dtype=np.uint64) - sums) ^ place)
    return signatures, counts.sum(1, keepdims=True) > counts


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set of distinct 64-bit features; none for the empty set."""
    found = []
    for instance in bands.of(len(features)) if len(features) else ():
        if not instance.parts:
            continue
        for seed in range(SEEDS):
            own, full = dealt(features, instance, seed)
            serves = int((~full).any(1).sum()) <= instance.spare
            found.append(own.ravel() if seed == SEEDS - 1 and not serves else own[full])
            if serves:
                break
    return np.concatenate(found) if found else np.zeros(0, np.uint64)
