from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echograph.llm import automaton as A
from echograph.llm import collocations as C

from .conftest import folded


def by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in often.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = [q for (other, q), c in often.items() if other == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not longer:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(ranked)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS slice", "'p' AS phrase", "2 AS k", "'b' AS body", "0 AS n", "true AS inside")


def corpus(seed, docs=120):
    """Few words with a few frequent phrases, two of which a third of all windows begin with."""
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "Gamma", "delta", "é", "中文", "naïve", "x", "zz", "of", "the"]
    rows = []
    for i in range(docs):
        out = []
        for _ in range(int(rng.integers(0, 60))):
            out.append(["of the", "of the alpha", "kept always together here now", words[rng.integers(len(words))]][min(3, int(rng.integers(0, 7)))])
            out.append([" ", " ", " ", "\t", ". ", "\n", ", "][rng.integers(7)])
        rows.append(([None, "und", "en", ""][i % 4], "".join(out)))
    return rows


@pytest.mark.parametrize("range_bytes, shard_words, questions", [(1 << 30, 1 << 20, 1 << 20), (500, 200, 3), (100, 1, 1 << 20)])
def test_by_hand_whatever_the_layout(spark, documents, range_bytes, shard_words, questions):
    documents([])
    rows = corpus(5)
    found = C.collocations(table(spark, rows).repartition(4), 3, 40, range_bytes, shard_words, questions)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == by_hand(rows, 3, 40)


def test_odd_texts_and_an_empty_table(spark, documents, odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()] + [("x\x1fy", "a\x1fb c\x00 a\x1fb c\x00"), (None, "UND und UND und"), ("long", "w " * 200_000)]
    found = C.collocations(table(spark, rows), 2, 50, 4000, 5000)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, 2, 50)
    assert C.collocations(table(spark, []), 2).collect() == []
    assert C.collocations(table(spark, [(None, None), ("en", "")]), 2).collect() == []


def test_scores_past_64_bits_are_exact():
    k = 3_000_000_007
    langs = pa.array(["en"] * 2)
    own = pa.RecordBatch.from_pydict({"slice": pa.array([0] * 2, pa.int32()), "lang": langs, "phrase": ["", "b"], "a": [9 * k, k], "rest": pa.array([None, None], pa.string()), "at": [None] * 2, "l": [None] * 2, "n": [None] * 2})
    asked = pa.RecordBatch.from_pydict({"slice": pa.array([0], pa.int32()), "lang": ["en"], "phrase": ["a b"], "at": [1], "a": [k - 2], "l": [k - 1], "n": [9 * k], "rest": ["b"]})
    (batch,) = C._answer(iter([own, asked]))
    assert batch.column("score").to_pylist() == [1000 * (k - 2) * 9 * k // ((k - 1) * k)]


def test_automata_give_their_paths_back_and_register_equal_states():
    rng = np.random.default_rng(2)
    words = pa.array([f"w{i:03}".encode() for i in range(300)], pa.binary())
    paths = rng.integers(1, 301, (A.DEPTH, 4000)).astype(np.int32)
    paths[3:, :1000] = 0
    paths[:, 1000:1500] = paths[:, 2000:2500]
    own, weights = A.summed(paths, np.ones(4000, np.int64), 300)
    built = A.Automaton.built(words, own, weights)
    again = A.Automaton.from_bytes(built.to_bytes())
    back, w = again.paths()
    assert (back == own).all() and (w == weights).all() and again.alphabet.equals(words)
    assert len(built.levels[-1][0]) < 700 < len(set(map(tuple, own[:5].T.tolist())))
    alphabet, both, sums = A.union([built, again, A.Automaton.built(pa.array([b"a", b"w000"]), np.array([[1, 2]] * A.DEPTH), np.array([5, 7]))])
    expected = Counter({tuple(f"w{x - 1:03}" for x in p if x): 2 * c for p, c in zip(own.T.tolist(), weights.tolist())})
    expected[("a",) * 6] += 5
    expected[("w000",) * 6] += 7
    names = [b"", *alphabet.to_pylist()]
    assert {tuple(names[x].decode() for x in p if x): c for p, c in zip(both.T.tolist(), sums.tolist())} == expected


def test_many_labels_need_more_keys():
    paths = np.random.default_rng(1).integers(0, 1 << 30, (A.DEPTH, 500))
    paths[:, 250:] = paths[:, :250]
    own, weights = A.summed(paths, np.ones(500, np.int64), 1 << 30)
    assert own.T.tolist() == sorted(map(list, {tuple(p) for p in paths.T.tolist()})) and set(weights) == {2}
    assert A.first_at_least(own, 1 << 30, own[:, [0, 7, 249]]).tolist() == [0, 7, 249]
