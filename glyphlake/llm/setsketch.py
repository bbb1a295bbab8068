"""Shingle sets of texts and their SetSketch registers, with numpy over whole batches of texts.

A register is a truncated, exponentially spaced minimum: floor(1 - log_b x) of the least of exponentially distributed
hash values x of a set's elements, kept between 0 and Q + 1. Registers of a union are the larger of each two, so sketches
merge, and two sets share a register with a probability that rises with their likeness."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WIDTH = 5
#: More registers make estimates sharper; bands take the first few of them.
REGISTERS, BASE, RATE, Q = 512, 1.1, 20.0, 254
_M = np.uint64(0x9E3779B97F4A7C15)
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _STEP[0]
    x = (x ^ (x >> np.uint64(27))) * _STEP[1]
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * _M)
FACTORS, SHIFTS = SEEDS[:REGISTERS] | np.uint64(1), SEEDS[REGISTERS:]


def powers(n: int) -> np.ndarray:
    out = np.full(n, _M, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1 << 10)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the words of UTF-8 bytes: A-Z lower-cased, words end at ASCII white space."""
    inside = np.flatnonzero((data != 32) & ((data < 9) | (data > 13)))
    if not len(inside):
        return inside, np.zeros(0, np.uint64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(inside)))
    longest = int(lengths.max())
    table = _POWERS if longest <= len(_POWERS) else powers(longest)
    letters = data[inside]
    letters = letters + np.where((letters >= 65) & (letters <= 90), np.uint8(32), np.uint8(0))
    offset = np.arange(len(inside)) - np.repeat(starts, lengths)
    hashes = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * table[offset], starts)
    return inside[starts], mixed(hashes)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; a text with fewer words is one shingle, an empty
    one has none."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    places, words = word_hashes(joined)
    last = np.searchsorted(places, ends)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * _M + words[k : k + len(rolled)]
    rolled = mixed(rolled)
    start = 0
    for end in last:
        n = end - start
        if n >= width:
            got = np.sort(rolled[start : end - width + 1])
            yield got[np.append(True, got[1:] != got[:-1])] if len(got) > 1 else got
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[start:end]:
                    one = one * _M + w
            yield mixed(np.array([one], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        start = end


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint8) of each set, one row a set; those of empty sets are 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    low = np.empty((len(full), REGISTERS), np.uint64)
    at = 0
    while at < len(full):
        upto, size = at, 0
        while upto < len(full) and (size == 0 or size + len(sets[full[upto]]) <= 1 << 14):
            size += len(sets[full[upto]])
            upto += 1
        group = [sets[i] for i in full[at:upto]]
        x = np.concatenate(group)
        bounds = np.cumsum([0, *map(len, group[:-1])])
        v = np.empty_like(x)
        for r in range(REGISTERS):
            np.multiply(x, FACTORS[r], out=v)
            np.add(v, SHIFTS[r], out=v)
            low[at:upto, r] = np.minimum.reduceat(v, bounds)
        at = upto
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    least = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, Q + 1).astype(np.uint8)
    return out


def larger(x: float) -> float:
    """The chance that a register is larger on the side that has a share x of the elements to itself."""
    return -math.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def equal_share(j: float) -> float:
    """The least chance, over all sizes, that two sets of Jaccard similarity j have a register in common: that of a set and
    a part of it, as `larger` grows faster than its argument."""
    return 1 - larger(1 - j)


@dataclass(frozen=True)
class Bands:
    """How registers are cut into bands, and from which estimates on a pair may be a link.

    bands bands of rows registers miss a pair at the threshold less than once in 1 / MISSED times; as many rows are taken as
    that allows with at most MOST_BANDS bands, or, where a low threshold would leave buckets of few rows, up to
    FEW_ROWS with as many bands as there are registers for. likely and likely_bands lie DEVIATIONS standard deviations
    below the threshold: the estimate from all registers, and the share of equal ones in the bands alone."""

    rows: int
    bands: int
    likely: float
    likely_bands: float


MISSED, MOST_BANDS, FEW_ROWS, DEVIATIONS = 1e-4, 32, 4, 4.2


def bands_for(percent: int) -> Bands:
    if not 1 <= percent <= 100:
        raise ValueError(f"a similarity of {percent} % can't be searched for")
    j = percent / 100
    equal = min(equal_share(j), 1 - 1e-9)
    needed = lambda rows: max(1, math.ceil(math.log(MISSED) / math.log1p(-(equal**rows))))
    fits = [r for r in range(1, 17) if r * needed(r) <= REGISTERS and (r <= FEW_ROWS or needed(r) <= MOST_BANDS)]
    rows = max(fits, default=1)
    bands = min(needed(rows), REGISTERS // rows)
    spread = math.sqrt(equal * (1 - equal))
    slope = (BASE - 1) / BASE / math.log(BASE)
    return Bands(rows, bands, j - DEVIATIONS * spread / math.sqrt(REGISTERS) / slope, equal - DEVIATIONS * spread / math.sqrt(rows * bands))


def likeness(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 12) -> np.ndarray:
    """Jaccard similarity of pairs of register rows by joint likelihood, given the sizes of their sets.

    Of the registers, a share 1 - P(u - v J) - P(v - u J) is equal, the others are larger on one side, where
    P(x) = -log_b(1 - x (b - 1) / b) and u, v are the sizes' shares; the counts of the three cases are multinomial.
    The likelihood has one maximum in J, which halving of the slope's sign finds."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    k, log_b = (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(steps):
        j = (low + high) / 2
        xu, xv = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        pu, pv = -np.log1p(-xu * k) / log_b, -np.log1p(-xv * k) / log_b
        du, dv = -v * k / (1 - xu * k) / log_b, -u * k / (1 - xv * k) / log_b
        slope = more * du / pu + less * dv / pv - same * (du + dv) / np.maximum(1 - pu - pv, 1e-12)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2
