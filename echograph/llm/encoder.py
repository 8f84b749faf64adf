"""Byte-level BPE over chunks of texts: every distinct piece of a chunk is encoded once.

A piece is a part of the text that the tokenizer's own pattern cannot cross: a
run without white space with the space before it, cut further where ASCII
letters, digits and other signs meet, and runs of white space as the pattern
takes them.  The library encodes the pieces; a text that holds one of the
tokenizer's added tokens is encoded whole.  Both give what encoding each whole
text gives.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from echograph.llm import words as W

#: Encoded pieces that a worker keeps between chunks, of some 40 bytes each.
KEPT_PIECES = 800_000

_SPACE, _LETTER, _DIGIT, _SIGN, _HIGH, _QUOTE = range(6)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x80:] = _HIGH
_CLASS[0x27] = _QUOTE
#: Neighbours that the pattern always parts.
_PARTED = np.zeros((6, 6), bool)
for _a in (_LETTER, _DIGIT, _SIGN):
    for _b in (_LETTER, _DIGIT, _SIGN):
        _PARTED[_a, _b] = _a != _b
_PARTED = _PARTED.ravel()

#: White space beyond ASCII, in UTF-8.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = np.array([ord(c) for _, c in sorted(_byte_letters().items())], "<u4")


def _mark_wide_spaces(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Turns the bytes of wide white space to white space; returns places inside such characters."""
    inside = np.zeros(len(data), bool)
    for lead in {s[0] for s in _WIDE_SPACES}:
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        for space in (s for s in _WIDE_SPACES if s[0] == lead):
            here = at[at + len(space) <= len(data)]
            for k, byte in enumerate(space):
                here = here[data[here + k] == byte]
            for k in range(len(space)):
                kinds[here + k] = _SPACE
                inside[here + k] = k > 0
    return inside


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pieces, and the class of every byte."""
    n = len(data)
    kinds = _CLASS[data]
    inside = _mark_wide_spaces(data, kinds)
    cut = np.zeros(n, bool)
    if not n:
        return np.empty(0, np.int64), kinds
    cut[1:] = _PARTED[kinds[:-1] * 6 + kinds[1:]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts, ends = W.runs(kinds == _SPACE, offsets)
    cut[starts] = True
    # A run before a word gives up its last character: a space goes to the word, another stays alone.
    closes = np.zeros(n + 1, bool)
    closes[offsets] = True
    before_word = ~closes[ends]
    last = ends[before_word] - 1
    while inside[last].any():
        last = np.where(inside[last], last - 1, last)
    cut[last] = True
    alone = data[last] != 0x20
    cut[ends[before_word][alone]] = True
    return np.flatnonzero(cut), kinds


class Encoder:
    def __init__(self, path: str, end_id: int | None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self._keep(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32))

    def _keep(self, keys: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> None:
        """The pieces kept: sorted hashes, and where each one's ids lie in the pool."""
        self.keys, self.sizes, self.pool = keys, sizes, pool
        self.starts = np.cumsum(sizes) - sizes

    def _add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New pieces, with sorted hashes."""
        at = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, at, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.pool = np.concatenate([self.pool, ids])

    def _encoded(self, body: bytes, letters: str, pieces: Iterable[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each (start, end, one class) piece, and all ids."""
        tokenize, ids, sizes = self.model.tokenize, array("I"), []
        before = 0
        for start, end, plain in pieces:
            if plain or body[start:end].decode().lstrip(" ").isalpha():
                ids.extend([t.id for t in tokenize(letters[start:end])])
            else:
                ids.extend(self._whole(body[start:end]))
            sizes.append(len(ids) - before)
            before = len(ids)
        return np.array(sizes, np.int64), np.array(ids, np.uint32)

    def _whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, each followed by the end id, and how many each text has."""
        rows = len(offsets) - 1
        starts, kinds = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = W.span_hashes(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != distinct) if len(self.keys) else np.arange(len(distinct))
        body = data.tobytes()
        if len(new):
            odd = np.zeros(len(data) + 1, np.int64)
            np.cumsum((kinds == _HIGH) | (kinds == _QUOTE) | ((kinds == _SPACE) & (data != 0x20)), out=odd[1:])
            a, b = starts[first[new]], ends[first[new]]
            plain = (odd[b] == odd[a]) & ~((data[b - 1] == 0x20) & (b - a > 1))
            letters = _LETTERS[data].tobytes().decode("utf-32-le")
            self._add(distinct[new], *self._encoded(body, letters, zip(a.tolist(), b.tolist(), plain.tolist(), strict=True)))
            place = np.searchsorted(self.keys, distinct)
        sizes, pool_at = self.sizes[place], self.starts[place]
        many = sizes[which]
        before = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.arange(before[-1]) + np.repeat(pool_at[which] - before[:-1], many)]
        if len(self.keys) > KEPT_PIECES:  # start again with those of this chunk
            self._keep(distinct, sizes, self.pool[np.arange(sizes.sum()) + np.repeat(pool_at - np.cumsum(sizes) + sizes, sizes)])
        row_from = before[np.searchsorted(starts, offsets)]  # ids before each row
        return self._closed(ids, row_from, body, offsets, rows)

    def _closed(self, ids: np.ndarray, row_from: np.ndarray, body: bytes, offsets: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        whole: dict[int, np.ndarray] = {}
        for token in self.added:
            at = body.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if row not in whole and at + len(token) <= offsets[row + 1]:
                    whole[row] = np.array(self._whole(body[offsets[row] : offsets[row + 1]]), np.uint32)
                at = body.find(token, at + 1)
        counts = np.diff(row_from)
        if whole:
            own = [whole.get(r, ids[row_from[r] : row_from[r + 1]]) for r in range(rows)]
            ids, counts = np.concatenate(own), np.array([len(x) for x in own])
        if self.end_id is None:
            return ids, counts
        return np.insert(ids, np.cumsum(counts), np.uint32(self.end_id)), counts + 1


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    """One for each worker."""
    return Encoder(path, end_id)
