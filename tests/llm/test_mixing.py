from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echograph.llm import mixing

from .conftest import plain_words


def naive_targets(sizes, weights, share, most):
    """The water level found by bisection."""
    budget, low, high = share * sum(sizes), 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * w) for s, w in zip(sizes, weights, strict=True)) < budget else (low, level)
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets_are_the_water_level(sizes):
    weights = mixing.cycled_weights(len(sizes))
    found = mixing.fill_targets(sizes, weights, 1.5)
    assert found == pytest.approx(naive_targets(sizes, weights, 1.5, 2.0), rel=1e-6, abs=1e-6)
    assert all(t <= 2 * s for t, s in zip(found, sizes, strict=True))


@settings(max_examples=200)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), st.floats(0, 150))
def test_small_fits_are_the_nearest_sums(histogram, budget):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    taken = mixing.fit(lengths, counts, budget)
    assert ((taken >= 0) & (taken <= counts)).all()
    if budget < (lengths * counts).sum():
        # The proportional part is fixed first; what is left is fitted as well as any choice can.
        fixed = np.floor(counts * (budget / (lengths * counts).sum())).astype(int)
        sums = [int((np.array(c) * lengths).sum()) for c in product(*(range(f, n + 1) for f, n in zip(fixed, counts, strict=True)))]
        best = min(abs(s - budget) for s in sums)
        assert abs(int((taken * lengths).sum()) - budget) <= best + 1  # the rest is a whole number of words


def test_large_fits_come_near():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for part in (0.013, 0.5, 0.99):
        taken = mixing.fit(lengths, counts, part * total)
        assert abs(int((taken * lengths).sum()) - part * total) <= 1


def result(docs):
    return mixing.mix_sizes(mixing.sized_documents(docs))


def test_odd_rows(odd):
    rows = result(odd).collect()
    assert len(rows) == odd.count()
    texts = {(r["doc_id"]): r["text"] for r in odd.collect()}
    for r in rows:
        if r["row"] is not None:
            assert r["size"] == len(plain_words(texts[r["row"]]))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        assert r["size"] or not r["taken"]


def test_empty_table(documents):
    assert result(documents([])).collect() == []
    assert mixing.mixed(documents([])).collect() == []


def test_sources_come_near_their_targets_and_reruns_agree(documents):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 40)), ["a", "b", None, "c"][min(3, i % 7)]) for i in range(600)]
    docs = documents(rows).repartition(5)
    found = result(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    names = sorted((s for s in by if s is not None)) + [None]
    want = dict(zip(names, mixing.fill_targets([sizes[s] for s in names], mixing.cycled_weights(len(names)), 1.5), strict=True))
    for source, own in by.items():
        assert {r["target"] for r in own} == {want[source]} and {r["source_size"] for r in own} == {sizes[source]}
        assert abs(sum(r["taken"] for r in own) - want[source]) <= 1
    again = result(docs.repartition(3)).collect()
    assert sorted((r["row"], r["taken"]) for r in found) == sorted((r["row"], r["taken"]) for r in again)


def test_a_third_of_all_rows_alike(documents):
    rows = [(1, "same words here", "hot")] * 300 + [(i, "w " * (i % 9), "cold") for i in range(2, 200)]
    found = result(documents(rows)).collect()
    hot = [r for r in found if r["source"] == "hot"]
    assert len(hot) == 300 and abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 2


def test_the_mix_repeats_whole_rows(odd):
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    taken = sum(r["taken"] for r in result(odd).collect())
    assert sum(len(plain_words(r["text"])) for r in mixed.collect()) == pytest.approx(taken, abs=3)


def test_rows_of_one_id_are_dealt_like_others(spark):
    """A third of all rows with one id: their places, not their id, spread them over the buckets."""
    rows = [(i, None if i % 3 else 7, "s", 5) for i in range(3000)]
    sized = spark.createDataFrame(rows, "row long, doc long, source string, size long")
    hashes = sized.selectExpr(f"shiftrightunsigned(xxhash64(17, doc, row), {64 - mixing.BUCKET_BITS}) AS bucket")
    assert max(r["count"] for r in hashes.groupBy("bucket").count().collect()) < 20
    found = mixing.mix_sizes(sized).collect()
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 5 and {r["copies"] for r in found} == {1, 2}


def test_the_knapsack_is_bounded_by_what_is_left_not_by_twice_the_longest_text():
    lengths, counts = np.array([3, 5_000_000]), np.array([10, 3])
    taken = mixing.fit(lengths, counts, 7_000_000.0)
    assert abs(int((taken * lengths).sum()) - 7_000_000) <= 2_000_000
