"""64-bit hashes of all words of a block of texts, from the Arrow buffer, without a Python object per word.

Words are what lies between the bytes 0x09-0x0D and 0x20. Two different words get the same hash
with a probability of about 2^-60.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from vespera.llm.common import text_buffer

ODD = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((salt * ODD + 0x632BE59BD9B4E019) & WRAP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
VALUE = mixed(np.arange(256, dtype=np.uint64), 77)
LOWER_VALUE = VALUE.copy()
LOWER_VALUE[65:91] = VALUE[97:123]
BASE, UNBASE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # byte where it starts, in `data`
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one more at the end
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    data, bounds = text_buffer(texts)
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64), data)
    word = ~BLANK[data]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    begin[inner] = word[inner]
    end[:-1] &= ~word[1:]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER_VALUE if lower else VALUE)[data] * powers(BASE, n), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(UNBASE, n)[starts], 1)
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds), data)


def grams(hashes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 have none."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += hashes[j : j + m] * np.uint64(pow(BASE, j + 1, 1 << 64))
    return mixed(out, salt)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """The words from which n words lie in one text."""
    counts = np.maximum(0, np.diff(first) - n + 1)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
