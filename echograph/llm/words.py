"""Words of whole Arrow batches as numpy arrays.

Texts of a batch lie end to end in one byte buffer, so words are found, hashed
and counted for many documents at once.  A chunk holds whole documents of about
``max_bytes``; a longer document is a chunk of its own.  Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

#: Java pattern of a word, as the kernel's ``PLAIN`` table finds it.
WORD = r"[^\x20\x09-\x0D]+"

#: Odd, so that it has an inverse modulo 2**64; 5 modulo 8, so that its powers differ.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(chars: list[int], inside: bool) -> np.ndarray:
    table = np.full(256, not inside)
    table[chars] = inside
    return table


#: Bytes of words: all but white space; and letters, digits and bytes over 127 (after folding A-Z).
PLAIN = _table([0x20, *range(0x09, 0x0E)], inside=False)
ALNUM = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)], inside=True)

#: Lower-cases A-Z, as a table over bytes.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def chunks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows' texts in them) of each chunk."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_string() if pa.types.is_string(texts.type) else texts.type).cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    _, places, body = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true places, cut where documents begin."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    start[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def owner(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte place belongs to."""
    return np.searchsorted(offsets, places, "right") - 1


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever it lies.

    A polynomial in the place with a random coefficient for each byte, taken
    from prefix sums.  Equal hashes of different spans are left to chance, about
    one in 2**64 for each pair.
    """
    coefficients = _BYTE[FOLD] if fold else _BYTE
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.take(coefficients, data, out=sums[1:])
    sums[1:] *= _power("down", len(data))
    np.cumsum(sums[1:], out=sums[1:])
    up = _power("up", len(data) + 1)
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int, ordered_from: np.uint64 = np.uint64(_BASE)) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, by the place of its first."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = total * ordered_from + words[k : k + count]
    return mix(total)


def counts_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true bytes each row has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
