"""Compressed FM-index over words: wavelet matrix, LCP values in one byte, and matching statistics of streamed texts.

The indexed text is a list of segments of symbols, each closed by a separator, and each with a value.
Suffixes are sorted by doubling to more symbols than `depth`, and the arrays of that are dropped:
what stays is the wavelet matrix of the symbols before each suffix (packed bits), the LCP of
neighbouring suffixes up to `depth`, and the least value of each interval of `depth` equal symbols.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector: packed words and a count before each word."""

    def __init__(self, bits: np.ndarray):
        size = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(size, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


def _pairs(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Ranks of (a at i, b at i + k); beyond the end there is nothing, which comes first."""
    later = np.zeros(len(b), np.int64)
    later[: len(b) - k] = b[k:] + 1
    return np.unique(a * (int(b.max(initial=0)) + 2) + later, return_inverse=True)[1]


class FMIndex:
    """symbols: the segments' symbols, concatenated; lengths, values: of each segment."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, values: np.ndarray, depth: int):
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        place = np.ones(len(text), bool)
        place[ends - 1] = False
        self.alphabet, code = np.unique(symbols, return_inverse=True)
        text[place] = code + 1
        self.size, self.depth = len(text), depth
        ranks = {1: text}
        k = 1
        while k <= depth:
            ranks[2 * k] = _pairs(ranks[k], ranks[k], k)
            k *= 2
        suffixes = np.argsort(ranks.pop(k), kind="stable")
        self._neighbours(suffixes, ranks)
        del ranks
        self._least(np.repeat(values, lengths + 1)[suffixes])
        last = text[suffixes - 1]
        self.levels: list[Bits] = []
        for b in reversed(range(max(1, int(len(self.alphabet)).bit_length()))):
            bit = (last >> b) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        every = np.arange(len(self.alphabet) + 1)
        self.smaller = np.searchsorted(np.sort(text), every)  # symbols below each one, in the text
        self.offset = self._down(every, np.zeros(len(every), np.int64))

    def _neighbours(self, suffixes: np.ndarray, ranks: dict[int, np.ndarray]) -> None:
        """lcp of each suffix and the one before (0 at both ends), and for each the nearest places of smaller ones."""
        p, q, same = suffixes[:-1], suffixes[1:], np.zeros(len(suffixes) - 1, np.int64)
        for k in sorted(ranks, reverse=True):
            padded = np.append(ranks[k], -1)
            same += k * (padded[np.minimum(p + same, self.size)] == padded[np.minimum(q + same, self.size)])
        self.lcp = np.zeros(self.size + 1, np.uint8)
        self.lcp[1:-1] = np.minimum(same, self.depth)
        self.left, self.right = np.zeros(self.size + 1, np.int32), np.full(self.size + 1, self.size, np.int32)
        for v in np.unique(self.lcp)[1:].tolist():
            own, below = np.flatnonzero(self.lcp == v), np.flatnonzero(self.lcp < v)
            after = np.searchsorted(below, own)
            self.left[own], self.right[own] = below[after - 1], below[after]

    def _least(self, values: np.ndarray) -> None:
        """Interval of `depth` equal symbols around each suffix, and the least value in it."""
        heads = np.flatnonzero(self.lcp[:-1] < self.depth)
        number = np.cumsum(self.lcp[:-1] < self.depth) - 1
        self.begin, self.end = heads.astype(np.int32)[number], np.append(heads[1:], self.size).astype(np.int32)[number]
        self.least = np.minimum.reduceat(values, heads)[number]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, level in zip(reversed(range(len(self.levels))), self.levels, strict=True):
            ones = level.ones(at)
            at = np.where((symbol >> b) & 1, level.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step of borders of suffix intervals: from those of P to those of symbol + P."""
        return self.smaller[symbol] + self._down(symbol, at) - self.offset[symbol]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of symbols in the index; 0: it has no such symbol."""
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, 0)

    def statistics(self, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of texts streamed through backward search, each from its end on.

        symbols[first[i] : first[i] + lengths[i]] is text i. Returns for each of all their symbols, text
        after text, how many symbols from there on occur in the index (`depth` at most), and the start of
        the suffix interval of these. Where a symbol doesn't continue a match, the match is cut to its
        next shorter interval until it does.
        """
        out = np.zeros(int(lengths.sum()), np.uint8), np.zeros(int(lengths.sum()), np.int32)
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        code, stop, place = self.codes(symbols), (first + lengths)[order], (begin + lengths)[order]
        low, high, depth = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64), np.zeros(len(order), np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            n = int(np.searchsorted(-size, -step, "right"))
            symbol = code[stop[:n] - step]
            unknown = np.flatnonzero(symbol == 0)
            low[unknown], high[unknown], depth[unknown] = 0, self.size, 0
            open_ = np.flatnonzero(symbol)
            while len(open_):
                c = symbol[open_]
                both = self.extend(np.concatenate([c, c]), np.concatenate([low[open_], high[open_]]))
                a, b = both[: len(c)], both[len(c) :]
                fits = a < b
                done = open_[fits]
                low[done], high[done] = a[fits], b[fits]
                depth[done] += 1
                open_ = open_[~fits]
                k = np.where(self.lcp[low[open_]] >= self.lcp[high[open_]], low[open_], high[open_])
                depth[open_] = self.lcp[k]
                low[open_], high[open_] = self.left[k], self.right[k]
            over = np.flatnonzero(depth[:n] > self.depth)
            low[over], high[over], depth[over] = self.begin[low[over]], self.end[low[over]], self.depth
            out[0][place[:n] - step], out[1][place[:n] - step] = depth[:n], low[:n]
        return out
