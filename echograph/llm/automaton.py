"""Weighted acyclic automata over word sequences of one length, as numpy arrays.

A path is a column of ``DEPTH`` labels; label 0 ends a shorter sequence and is
the smallest.  Other labels are places, from 1, in the automaton's own alphabet,
which is sorted by bytes, so sorted paths are sorted sequences.  Paths come in
sorted and are read level by level from the ends: a state with one way on is
registered, so that equal ones are one state (nearly all states near the ends are
such).  The weight of a path lies on its last arc.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEPTH = 6


def sorted_alphabet(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct entries in byte order, and the label of each entry of ``words``."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1, dtype=np.int32)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _keys(paths: np.ndarray, labels: int) -> list[np.ndarray]:
    """The labels of each path packed into few integers, most significant first."""
    bits = max(1, int(labels).bit_length())
    each = 63 // bits
    keys = []
    for at in range(0, DEPTH, each):
        key = np.zeros(paths.shape[1], np.int64)
        for row in paths[at : at + each]:
            key = (key << bits) | row
        keys.append(key)
    return keys


def summed(paths: np.ndarray, weights: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct paths with the sums of their weights; labels are at most ``labels``."""
    if not paths.shape[1]:
        return paths, weights
    keys = _keys(paths, labels)
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(fresh)
    return paths[:, order[starts]], np.add.reduceat(weights[order], starts)


def first_at_least(paths: np.ndarray, labels: int, wanted: np.ndarray) -> np.ndarray:
    """For each wanted path, the place of the first of the sorted ``paths`` that is not below it."""
    low, high = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], paths.shape[1])
    done = np.zeros(wanted.shape[1], bool)
    for key, want in zip(_keys(paths, labels), _keys(wanted, labels), strict=True):
        for i in np.flatnonzero(~done):
            part = key[low[i] : high[i]]
            a, b = np.searchsorted(part, want[i], "left"), np.searchsorted(part, want[i], "right")
            low[i], high[i] = low[i] + a, low[i] + b
            done[i] = a == b
    return low


def fresh_prefixes(paths: np.ndarray) -> list[np.ndarray]:
    """For each length, the places of sorted paths where a prefix of that length begins."""
    fresh = np.zeros(paths.shape[1], bool)
    fresh[:1] = True
    out = []
    for row in paths:
        fresh[1:] |= row[1:] != row[:-1]
        out.append(np.flatnonzero(fresh))
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


@dataclass
class Automaton:
    """``levels[j]``: ways on of each state of that level, and the arcs' labels and targets (weights in the last)."""

    alphabet: pa.Array
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def built(cls, alphabet: pa.Array, paths: np.ndarray, weights: np.ndarray) -> Automaton:
        """From sorted distinct paths (at least one)."""
        begins = fresh_prefixes(paths)
        levels = []
        ends = weights  # what each arc of the level leads to
        for j in range(DEPTH - 1, -1, -1):
            labels = paths[j, begins[j]]
            states = np.searchsorted(begins[j], begins[j - 1]) if j else np.zeros(1, np.int64)  # first arc of each state
            ways = np.diff(np.append(states, len(labels)))
            single = np.flatnonzero(ways == 1)
            other = np.flatnonzero(ways != 1)
            at = states[single]
            order = np.lexsort((ends[at], labels[at]))
            at = at[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (labels[at[1:]] != labels[at[:-1]]) | (ends[at[1:]] != ends[at[:-1]])
            name = np.empty(len(states), np.int64)
            name[single[order]] = np.cumsum(fresh) - 1
            registered = at[fresh]
            name[other] = len(registered) + np.arange(len(other))
            arcs = np.concatenate([registered, expanded(states[other], ways[other])])
            levels.append((np.concatenate([np.ones(len(registered), np.int64), ways[other]]), labels[arcs], ends[arcs]))
            ends = name
        return cls(alphabet, levels[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths, sorted, and their weights."""
        states = np.zeros(1, np.int64)
        rows: list[np.ndarray] = []
        for ways, labels, ends in self.levels:
            firsts = np.cumsum(ways) - ways
            many = ways[states]
            arcs = expanded(firsts[states], many)
            rows = [np.repeat(row, many) for row in rows] + [labels[arcs].astype(np.int32)]
            states = ends[arcs].astype(np.int64)
        return np.stack(rows), states

    def to_bytes(self) -> bytes:
        lengths = pc.binary_length(self.alphabet).to_numpy().astype(np.int64)
        arrays = [_narrow(lengths), *[_narrow(a) for level in self.levels for a in level]]
        head = struct.pack(f"<{2 * len(arrays)}Q", *[x for a in arrays for x in (a.itemsize, len(a))])
        plain = b"".join([head, *[a.tobytes() for a in arrays], *self.alphabet.to_pylist()])
        return struct.pack("<Q", len(plain)) + pa.Codec("zstd", 1).compress(plain, asbytes=True)

    @classmethod
    def from_bytes(cls, body: bytes) -> Automaton:
        plain = pa.Codec("zstd", 1).decompress(body[8:], struct.unpack("<Q", body[:8])[0], asbytes=True)
        n = 1 + 3 * DEPTH
        head = struct.unpack(f"<{2 * n}Q", plain[: 16 * n])
        at, arrays = 16 * n, []
        for size, count in zip(head[::2], head[1::2], strict=True):
            arrays.append(np.frombuffer(plain, f"<u{size}", count, at).astype(np.int64))
            at += size * count
        places = np.concatenate([[0], np.cumsum(arrays[0])]).astype(np.int32)
        alphabet = pa.Array.from_buffers(pa.binary(), len(arrays[0]), [None, pa.py_buffer(places), pa.py_buffer(plain[at:])])
        return cls(alphabet, [tuple(arrays[i : i + 3]) for i in range(1, n, 3)])


def expanded(firsts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many[i]`` consecutive numbers from ``firsts[i]``, one after the other."""
    before = np.cumsum(many) - many
    return np.arange(int(many.sum())) + np.repeat(firsts - before, many)


def union(automata: list[Automaton]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One alphabet, and all paths with the sums of their weights."""
    alphabet, labels = sorted_alphabet(pa.concat_arrays([a.alphabet for a in automata]))
    parts, weights, at = [], [], 0
    for a in automata:
        own = np.concatenate([np.zeros(1, np.int32), labels[at : at + len(a.alphabet)]])
        at += len(a.alphabet)
        paths, w = a.paths()
        parts.append(own[paths])
        weights.append(w)
    paths, sums = summed(np.concatenate(parts, axis=1), np.concatenate(weights), len(alphabet))
    return alphabet, paths, sums


class Counts:
    """Weights of all prefixes of a set of sequences: what a sequence is looked up in.

    Every prefix of a sequence must be in the set or be asked for nowhere.
    """

    def __init__(self, sequences: list[tuple[bytes, ...]], weights: np.ndarray) -> None:
        used = sorted({w for s in sequences for w in s})
        self.alphabet = pa.array(used, pa.binary())
        self.labels = {w: i + 1 for i, w in enumerate(used)}
        paths = np.zeros((DEPTH, len(sequences)), np.int64)
        for i, s in enumerate(sequences):
            for j, w in enumerate(s):
                paths[j, i] = self.labels[w]
        order = np.lexsort(paths[::-1])
        self._paths, self._weights = paths[:, order], np.asarray(weights)[order]
        self.arcs = []
        length = (self._paths > 0).sum(axis=0)
        state = np.zeros(len(order), np.int64)
        for j in range(DEPTH):
            key = state * (len(used) + 1) + self._paths[j]
            keys, state = np.unique(key, return_inverse=True)
            value = np.zeros(len(keys), np.int64)
            whole = length == j + 1
            value[state[whole]] = self._weights[whole]
            self.arcs.append((keys, value))

    def composed(self, words: pa.Array, lengths: np.ndarray) -> np.ndarray:
        """Weight of each sequence, 0 if it is not in the set; ``words`` holds all, one after the other."""
        found = pc.fill_null(pc.index_in(words, value_set=self.alphabet), -1).to_numpy(zero_copy_only=False) + 1
        first = np.cumsum(lengths) - lengths
        state, out = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        alive = lengths > 0
        for j, (keys, value) in enumerate(self.arcs):
            alive &= lengths > j
            on = np.flatnonzero(alive)
            if not len(on):
                break
            label = found[first[on] + j]
            key = state[on] * (len(self.alphabet) + 1) + label
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (label > 0) & (keys[at] == key)
            alive[on[~hit]] = False
            state[on[hit]] = at[hit]
            last = hit & (lengths[on] == j + 1)
            out[on[last]] = value[at[last]]
        return out
