"""Elias-Fano sequences and a two-level n-gram trie in one memory-mapped file.

All queries take arrays.  A trie holds words, the contexts among them, monotone
pointers from contexts to their successors, and the successors themselves as
one sequence that each context continues from its own base, so that a
successor search for (context, word) is a search for one number.
"""

from __future__ import annotations

import json

import numpy as np

from echograph.llm.fmindex import Bits
from echograph.llm.tokenfile import pack, width_of

_ALIGN = 64


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with ``rank`` ones before it in each 64-bit word."""
    place = np.zeros(len(words), np.uint64)
    rank = rank.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = (words >> place) & np.uint64((1 << step) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = rank >= ones
        rank -= np.where(up, ones, 0)
        place += np.where(up, np.uint64(step), np.uint64(0))
    return place.astype(np.int64)


def read_packed(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Values at places ``at`` of a packed stream of ``width`` bits each."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    value = words[word] >> shift
    over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
    value[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return value & np.uint64((1 << width) - 1)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer(pack(values, width), np.uint64) if width else np.empty(0, np.uint64)


class EliasFano:
    """A sorted sequence of numbers below ``universe``: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.n, self.low_bits, self.low = n, low_bits, low
        self.high, self.before = high, before
        self.zeros = (np.arange(len(high), dtype=np.int64) << 6) - before

    @classmethod
    def arrays(cls, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        flags = np.zeros(n + (universe >> bits) + 2, bool)
        flags[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        index = Bits(flags)
        low = packed(values & np.uint64((1 << bits) - 1), bits)
        return {"meta": np.array([n, bits]), "low": low, "high": index.words, "before": index.before}

    @classmethod
    def open(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.meta"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.before"])

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part under ``high``."""
        rank = high - 1
        safe = np.maximum(rank, 0)
        word = np.searchsorted(self.zeros, safe, "right") - 1
        place = _select_in_word(~self.high[word], safe - self.zeros[word])
        return np.where(rank < 0, 0, (word << 6) + place - safe)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, at, "right") - 1
        place = _select_in_word(self.high[word], at - self.before[word])
        high = ((word << 6) + place - at).astype(np.uint64)
        return high << np.uint64(self.low_bits) | read_packed(self.low, self.low_bits, at)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number not under each value, and whether it is that value."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        lo, end = self._below(high), self._below(high + 1)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            right = read_packed(self.low, self.low_bits, mid) < low[open_]
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        equal = lo < end
        inside = np.flatnonzero(equal)
        equal[inside] = read_packed(self.low, self.low_bits, lo[inside]) == low[inside]
        return lo, equal


#: Logarithms of discounted counts have codes of 16 bits on one scale: from ``LOWEST`` (a count of a millionth) on, ``STEP`` apart.
LOWEST, STEP = -6.0, 2.0**-11


def quantised(values: np.ndarray) -> np.ndarray:
    """The code of the nearest value below, so sums never grow.

    The scale is the same for every trie: how a corpus is dealt over shards changes no value.
    """
    return np.clip(np.floor((values - LOWEST) / STEP), 0, 65535).astype(np.uint16)


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays behind a JSON head, each aligned for a memory map."""
    at, head, parts = 0, {}, []
    for name, array in arrays.items():
        body = np.ascontiguousarray(array).tobytes()
        head[name] = [array.dtype.str, at, len(array)]
        fill = -len(body) % _ALIGN
        parts += [body, b"\0" * fill]
        at += len(body) + fill
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % _ALIGN)
    return b"".join([len(text).to_bytes(8, "little"), text, *parts])


def from_buffer(body: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays as views of the file's bytes, such as a memory map."""
    size = int.from_bytes(body[:8].tobytes(), "little")
    head = json.loads(body[8 : 8 + size].tobytes())
    at = 8 + size
    return {k: np.frombuffer(body, np.dtype(t), n, at + start) for k, (t, start, n) in head.items()}


class Trie:
    """Unigram counts and quantised discounted bigram counts of one shard of contexts: their quotient is the smoothed probability."""

    def __init__(self, body: np.ndarray) -> None:
        arrays = from_buffer(body)
        self.words = arrays["words"]
        self.count_width = int(arrays["count_width"][0])
        self.counts = arrays["counts"]
        self.contexts = EliasFano.open(arrays, "contexts")
        self.pointers = EliasFano.open(arrays, "pointers")
        self.successors = EliasFano.open(arrays, "successors")
        self.discounted = arrays["discounted"]
        self.discount = float(arrays["discount"][0])

    @staticmethod
    def build(words: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray, discount: float) -> bytes:
        """From sorted distinct word hashes and bigrams (context, word: places in ``words``) sorted by both."""
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.empty(0, np.int64)
        contexts = context[first]
        follow = np.diff(np.append(first, len(context)))
        totals = np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64)
        place = np.repeat(np.arange(len(contexts)), follow)
        width = width_of(int(totals.max(initial=0)) + 1)
        parts = {
            "words": words,
            "counts": packed(totals, width),
            "count_width": np.array([width]),
            "discounted": quantised(np.log10(n - discount)),
            "discount": np.array([discount]),
        }
        size = max(1, len(words))
        for name, values, universe in (
            ("contexts", contexts, size),
            ("pointers", np.append(first, len(context)), len(context) + 1),
            ("successors", place.astype(np.uint64) * np.uint64(size) + word.astype(np.uint64), max(1, len(contexts)) * size),
        ):
            parts |= {f"{name}.{k}": v for k, v in EliasFano.arrays(values, universe).items()}
        return to_bytes(parts)

    def _word(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def context(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the contexts, and whether it is one."""
        at, known = self._word(hashes)
        place, found = self.contexts.find(at)
        return place, known & found

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Training count of each word as a context; 0 if unknown."""
        place, known = self.context(hashes)
        out = np.zeros(len(hashes), np.int64)
        out[known] = read_packed(self.counts, self.count_width, place[known]).astype(np.int64)
        return out

    def followers(self, place: np.ndarray) -> np.ndarray:
        """How many different words follow each context."""
        return (self.pointers[place + 1] - self.pointers[place]).astype(np.int64)

    def bigram(self, place: np.ndarray, known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the discounted share of each (context place, word hash), and whether it was seen."""
        out = np.zeros(len(place))
        at, there = self._word(words)
        ask = np.flatnonzero(known & there)
        targets = place[ask].astype(np.uint64) * np.uint64(max(1, len(self.words))) + at[ask].astype(np.uint64)
        found, equal = self.successors.find(targets)
        ask, found = ask[equal], found[equal]
        total = read_packed(self.counts, self.count_width, place[ask])
        out[ask] = LOWEST + self.discounted[found] * STEP - np.log10(total.astype(np.float64))
        seen = np.zeros(len(place), bool)
        seen[ask] = True
        return out, seen
