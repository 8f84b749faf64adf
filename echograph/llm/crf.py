"""Linear-chain conditional random field over word shapes, in numpy.

Label 0 is "none"; a sequence is taken to stand between two words of label 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from echograph.llm import words as W

#: Hashed features of a word: rows of the weight table.
FEATURES = 1 << 13
_ROLES = 3  # the word itself, the one before, the one after

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")
_SIGN = np.ones(256, bool)
_SIGN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?%\"'")] = True


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def word_types(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each distinct kind of word (kind, feature), and the kind of each word.

    Signs that end a clause are left off, three of them at most.
    """
    for _ in range(3):
        ends = ends - ((ends - starts > 1) & _CLOSING[data[ends - 1]])
    shape = _SHAPE[data]
    kept = np.ones(len(shape), bool)  # the first of each run of like signs
    kept[1:] = shape[1:] != shape[:-1]
    kept[starts] = True
    place = np.zeros(len(shape) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    shapes = W.span_hashes(shape[kept], place[starts], place[ends])
    digits = np.minimum(_between(shape == ord("0"), starts, ends), 20)
    dots = np.minimum(_between(data == ord("."), starts, ends), 4)
    signs = np.minimum(_between(_SIGN[data], starts, ends), 6)
    key = W.mix(shapes + digits.astype(np.uint64))
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    parts = [shapes, digits.astype(np.uint64), (digits * 64 + dots * 8 + signs).astype(np.uint64)]
    features = np.stack([np.full(len(first), 7, np.uint64), *(W.mix(p[first] + np.uint64(1000 * (k + 1))) for k, p in enumerate(parts))], axis=1)
    return features, kind


def _rows(features: np.ndarray, role: int) -> np.ndarray:
    return (W.mix(features + np.uint64(77 * role)) % np.uint64(FEATURES)).astype(np.int64)


@dataclass
class Chain:
    weights: np.ndarray  # (FEATURES, labels)
    moves: np.ndarray  # (labels, labels): from, to

    def _scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
        features, kind = word_types(data, starts, ends)
        own, before, after = (self.weights[_rows(features, role)].sum(1) for role in range(_ROLES))
        scores = own[kind]
        same = line[1:] == line[:-1]
        scores[1:] += before[kind[:-1]] * same[:, None]
        scores[:-1] += after[kind[1:]] * same[:, None]
        return scores

    def decode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best label of each word; words of one line follow each other.

        Where label 0 leads by more than two moves can ever make up, every best
        path has label 0, so the chain falls apart there.  What is left between
        such words is decoded for all pieces at once.
        """
        labels = np.zeros(len(starts), np.int8)
        if not len(starts):
            return labels
        scores = self._scores(data, starts, ends, line)
        reach = 2 * float(self.moves.max() - self.moves.min())
        unsure = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(1) <= reach)
        if not len(unsure):
            return labels
        new = np.ones(len(unsure), bool)
        new[1:] = (unsure[1:] != unsure[:-1] + 1) | (line[unsure[1:]] != line[unsure[:-1]])
        begin = unsure[new]
        size = np.diff(np.append(np.flatnonzero(new), len(unsure)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        back = []
        best = self.moves[0] + scores[begin]
        finals = np.empty_like(best)
        for t in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -t))  # pieces longer than t
            finals[live : len(best)] = best[live:]
            if not live:
                break
            paths = best[:live, :, None] + self.moves[None]
            back.append(paths.argmax(1).astype(np.int8))
            best = paths.max(1) + scores[begin[:live] + t]
        state = (finals + self.moves[:, 0]).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t))
            labels[begin[:live] + t] = state[:live]
            if t:
                state[:live] = back[t - 1][np.arange(live), state[:live]]
        return labels


def train(rows: list[tuple[list[str], list[int]]], labels: int, rounds: int = 60, rate: float = 0.15, shrink: float = 1e-4) -> Chain:
    """Maximum likelihood with a small penalty, by full gradient steps whose sizes follow running moments.

    ``rows`` is a bounded table.  Without rows every word gets label 0.
    """
    chain = Chain(np.zeros((FEATURES, labels), np.float32), np.zeros((labels, labels), np.float32))
    if not rows:
        chain.weights[_rows(np.full((1, 1), 7, np.uint64), 0), 0] = 1.0
        return chain
    texts = [" ".join(words).encode() for words, _ in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    starts, ends = W.runs(W.PLAIN[data], offsets)
    features, kind = word_types(data, starts, ends)
    sizes = np.array([len(words) for words, _ in rows])
    n, longest = len(rows), int(sizes.max())
    inside = np.arange(longest)[None] < sizes[:, None]
    words = np.zeros((n, longest), np.int64)
    words[inside] = kind
    gold = np.zeros((n, longest), np.int64)
    gold[inside] = np.concatenate([marks for _, marks in rows])
    follows = inside[:, 1:]  # the word after, and so the pair
    tables = [_rows(features, role) for role in range(_ROLES)]
    kinds = len(features)
    eye = np.eye(labels, dtype=np.float32)
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (chain.weights, chain.moves)]

    for turn in range(1, rounds + 1):
        own, before, after = (chain.weights[t].sum(1) for t in tables)
        scores = own[words]
        scores[:, 1:] += before[words[:, :-1]]
        scores[:, :-1] += after[words[:, 1:]] * follows[:, :, None]
        moves = chain.moves
        forward = np.empty_like(scores)
        forward[:, 0] = scores[:, 0] + moves[0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[None], axis=1) + scores[:, t]
            forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1] + moves[:, 0], axis=1)
        backward = np.empty_like(scores)
        backward[:, -1] = moves[:, 0]
        pairs = np.zeros((labels, labels), np.float64)
        for t in range(longest - 2, -1, -1):
            ahead = scores[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp.reduce(moves[None] + ahead[:, None], axis=2)
            live = inside[:, t + 1, None]
            backward[:, t] = np.where(live, step, moves[:, 0])
            joint = np.exp(forward[:, t, :, None] + moves[None] + ahead[:, None] - total[:, None, None])
            pairs += (joint * live[:, :, None]).sum(0)
        share = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
        pairs[0] += share[:, 0].sum(0)
        ends_at = share[np.arange(n), sizes - 1]
        pairs[:, 0] += ends_at.sum(0)

        error = eye[gold] * inside[:, :, None] - share
        gradient = np.zeros_like(chain.weights)
        roles = [
            (words[inside], error[inside]),
            (words[:, :-1][follows], error[:, 1:][follows]),
            (words[:, 1:][follows], error[:, :-1][follows]),
        ]
        for table, (which, part) in zip(tables, roles, strict=True):
            by_kind = np.stack([np.bincount(which, part[:, y], kinds) for y in range(labels)], axis=1)
            for column in table.T:
                np.add.at(gradient, column, by_kind)
        real = np.zeros((labels, labels))
        np.add.at(real, (gold[:, :-1][follows], gold[:, 1:][follows]), 1)
        np.add.at(real, (np.zeros(n, int), gold[:, 0]), 1)
        np.add.at(real, (gold[np.arange(n), sizes - 1], np.zeros(n, int)), 1)
        slopes = ((gradient - shrink * n * chain.weights) / n, (real - pairs) / n)
        for values, slope, (mean, square) in zip((chain.weights, chain.moves), slopes, moments, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            values += (rate * mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
    return chain
