"""Token files: ids in the fewest bits that hold the vocabulary, with offsets of blocks and documents.

All numbers are little-endian.  A file is a header, the documents' ids and
null flags, the places of their first tokens, the byte places of the blocks,
and the blocks.  A block holds ``block`` ids (the last one fewer), id ``k`` in
bits ``k * width`` and up; 64 ids fill ``width`` 64-bit words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"IDS1"
#: Ids in a block; a multiple of 64.
BLOCK = 4096
_HEADER = struct.Struct("<4sIIQQQ")  # magic, width, block, ids, documents, ids before this file


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, filled up to 64 ids with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((64, groups), np.uint64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    lanes[:] = padded.reshape(groups, 64).T
    out = np.zeros((width, groups), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    groups = -(-n // 64)
    words = np.ascontiguousarray(packed[: groups * width * 8].view("<u8").reshape(groups, width).T)
    out = np.empty((groups, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        lane = words[word] >> np.uint64(shift)
        if shift + width > 64:
            lane = lane | words[word + 1] << np.uint64(64 - shift)
        out[:, k] = lane & mask
    return out.reshape(-1)[:n]


def write(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int, before: int = 0, block: int = BLOCK) -> bytes:
    """The bytes of a file.  ``before``: ids in the files before it."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    places = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    blocks = [pack(ids[i : i + block], width) for i in range(0, len(ids), block)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = _HEADER.pack(MAGIC, width, block, len(ids), len(doc_ids), before)
    fill = b"\0" * (-(len(head) + len(null)) % 8)
    return b"".join([head, null.tobytes(), fill, known.tobytes(), places.tobytes(), at.tobytes(), *blocks])


class TokenFile:
    """Random access to a file's bytes, or to its memory map (``np.memmap(path, np.uint8, 'r')``)."""

    def __init__(self, body: np.ndarray) -> None:
        magic, self.width, self.block, self.n_ids, self.n_docs, self.before = _HEADER.unpack(body[: _HEADER.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size
        self.null = body[at : at + self.n_docs].astype(bool)
        at += self.n_docs
        at += -at % 8
        self.doc_ids = np.frombuffer(body[at : at + 8 * self.n_docs].tobytes(), "<i8")
        at += 8 * self.n_docs
        self.places = np.frombuffer(body[at : at + 8 * (self.n_docs + 1)].tobytes(), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.block_at = np.frombuffer(body[at : at + 8 * (n_blocks + 1)].tobytes(), "<u8").astype(np.int64)
        self.payload = body[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at places [start, end) of the file: only their blocks are read."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        if self.block % 64 == 0:  # whole blocks follow each other without gaps
            packed = np.array(self.payload[self.block_at[first] : self.block_at[last + 1]])
            return unpack(packed, self.width, n)[start - first * self.block : end - first * self.block]
        parts = []
        for b in range(first, last + 1):
            packed = np.array(self.payload[self.block_at[b] : self.block_at[b + 1]])
            parts.append(unpack(packed, self.width, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.places[k], self.places[k + 1])
