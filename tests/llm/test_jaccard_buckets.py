"""Large buckets of several components: who is compared with whom, and in how large a group."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from echograph.llm import jaccard

from .test_jaccard import brute, found


def sketches(n):
    return [bytes(8 * jaccard.SKETCH_WORDS)] * n


def test_dealt_groups_are_bounded_and_hold_all_pairs_once(spark):
    rng = random.Random(4)
    buckets = {1: [7] * 90 + [8], 2: [5] * 40 + list(range(100, 160)), 3: [1, 1, 2], 4: list(range(30)), 5: [9] * 8}
    rows = [(sig, rng.getrandbits(62), part) for sig, parts in buckets.items() for part in parts]
    sets = spark.createDataFrame([(node, 10, sketches(1)[0]) for _, node, _ in rows], "node long, size long, sketch binary")
    dealt = jaccard._dealt(spark.createDataFrame(rows, "sig long, node long, part long"), sets, 8).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r["sig"], r["i"], r["j"]), []).append(r)
    met = Counter()
    for (sig, i, j), held in groups.items():
        assert len(held) <= 50, (sig, i, j, len(held))
        for x in held:
            for y in held:
                if x["part"] < y["part"] and (i == j or x["side"] != y["side"]):
                    met[sig, frozenset((x["node"], y["node"]))] += 1
    want = {(s, frozenset((x, y))) for s, x, p in rows for t, y, q in rows if s == t and p < q}
    assert set(met) == want and set(met.values()) == {1}
    assert sum(r["sig"] == 1 for r in dealt) < 120  # one node outside: the others move once


def test_pairs_of_one_component_are_not_compared(monkeypatch):
    compared = 0
    count = np.bitwise_count

    def counting(x):
        nonlocal compared
        compared += x.size
        return count(x)

    monkeypatch.setattr(np, "bitwise_count", counting)
    n = 5000
    part = np.array([1] * n + [2])
    zero = np.zeros(n + 1, np.int64)
    columns = {"sig": zero, "i": zero, "j": zero, "side": zero, "node": np.arange(n + 1), "part": part, "size": zero + 10}
    batch = pa.RecordBatch.from_pydict({**{k: pa.array(v) for k, v in columns.items()}, "sketch": pa.array(sketches(n + 1), pa.binary())})
    pairs = [p for out in jaccard._across(iter([batch[:1700], batch[1700:]]), 9) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert sorted(pairs) == [(n, v) for v in range(n)]
    assert compared <= 2 * n * jaccard.SKETCH_WORDS


def test_small_blocks_give_the_same_components(documents):
    rng = random.Random(14)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):  # near copies and texts further off that share most of them
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            copy[rng.randrange(100)] = f"x{rng.randint(0, 50)}"
        rows.append((i, " ".join(copy)))
    want = brute(rows)
    assert 2 < len({w[2] for w in want}) < len(want)
    assert found(documents(rows), deal=3) == want
    assert found(documents(rows)) == want
