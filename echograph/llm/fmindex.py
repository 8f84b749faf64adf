"""FM-index over a sequence of words: suffix order, wavelet-matrix ranks, sampled positions.

Every method works on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

#: Every so many text places one suffix keeps its position.
SAMPLE = 16


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Place of each suffix in suffix order; a suffix that ends sorts before its extensions.

    Suffixes are ordered by their first 1, 3, 9, ... symbols; only those not yet
    told apart are sorted again.
    """
    n = len(symbols)
    bits = int(n + 1).bit_length()
    fan = 3 if 3 * bits <= 63 else 2
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    open_, depth = np.arange(n), 1
    while len(open_):
        key = rank[open_]
        for k in range(1, fan):
            after = open_ + k * depth
            inside = after < n
            after[~inside] = 0
            key = (key << bits) | np.where(inside, rank[after], 0)
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.arange(len(key))
        head = np.maximum.accumulate(np.where(new, at, 0))  # first of those still alike
        if depth == 1:
            rank[open_] = head + 1
        else:
            old = rank[open_]
            fresh = np.ones(len(old), bool)
            fresh[1:] = old[1:] != old[:-1]
            group = np.maximum.accumulate(np.where(fresh, at, 0))
            rank[open_] = old + head - group
        last = np.ones(len(new), bool)
        last[:-1] = new[1:]
        open_ = open_[~(new & last)]
        depth *= fan
    return rank - 1


class Bits:
    """A bit vector with counts of ones before any place."""

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros(len(flags) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before ``at``."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        rest = symbols.astype(np.int32)
        for bit in range(self.depth - 1, -1, -1):
            flags = (rest >> bit & 1).astype(bool)
            self.levels.append((Bits(flags), int(len(rest) - np.count_nonzero(flags))))
            rest = np.concatenate([rest[~flags], rest[flags]])

    def follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``at`` carried down to the leaf of ``symbols``; differences of two such places are ranks."""
        for level, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where(symbols >> (self.depth - 1 - level) & 1 > 0, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at`` and these places carried down to their leaves."""
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one = bits[at]
            ones = bits.ones(at)
            symbols = symbols << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at


class FMIndex:
    """Index of a sequence of symbols of 2 and more; 1 separates documents, 0 is added as its end."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.append(symbols, 0)
        rank = suffix_ranks(text)
        before = np.empty(len(text), np.int64)  # the symbol before each suffix, in suffix order
        before[rank] = np.roll(text, 1)
        self.size = len(text)
        self.matrix = WaveletMatrix(before)
        top = int(text.max()) + 1
        counts = np.bincount(text, minlength=top)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        every = np.arange(top)
        self.first = self.first - self.matrix.follow(every, np.zeros(top, np.int64))
        marked = np.zeros(len(text), bool)
        kept = np.arange(0, len(text), sample)
        marked[rank[kept]] = True
        self.marked = Bits(marked)
        self.positions = kept[np.argsort(rank[kept])]

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase ``words[start : start + length]``."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size)
        live = np.arange(len(starts))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= step) & (high[live] > low[live])]
            symbol = words[starts[live] + lengths[live] - step]
            base = self.first[symbol]
            low[live] = base + self.matrix.follow(symbol, low[live])
            high[live] = base + self.matrix.follow(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows, by steps back to the nearest sampled suffix."""
        found, at, walking, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(walking):
            here = at[walking]
            sampled = self.marked[here]
            done = walking[sampled]
            found[done] = self.positions[self.marked.ones(here[sampled])] + steps
            walking, here = walking[~sampled], here[~sampled]
            symbol, leaf = self.matrix.read(here)
            at[walking] = self.first[symbol] + leaf
            steps += 1
        return found
