from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echograph.llm import jaccard
from echograph.llm.components import components

from .conftest import folded, plain_words


def shingle_set(text):
    words = plain_words(folded(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) or frozenset([tuple(words)])


def brute(rows):
    """[(id, size, component id)] of (id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                part[max(root(i), root(j))] = min(root(i), root(j))
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    return sorted(((i, len(s), smallest.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(docs, **how):
    return sorted((tuple(r) for r in jaccard.joined(docs, **how).collect()), key=str)


def test_against_brute_force(documents):
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 9, 11, 12, 14, 20, 30, 45, 80, 150, 400]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 7)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [f"n{rng.randint(0, 99)}"] * rng.randint(0, 1)
                copy = copy or ["z"]
            texts.append(" ".join(copy))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert len({w[2] for w in want}) < len(want)
    assert found(documents(rows).repartition(5)) == want


def test_chains_of_links_and_a_large_group(documents):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # neighbours are similar, the ends are not
        words[rng.randrange(120)] = f"c{i}"
        rows.append((i, " ".join(words)))
    base = [f"b{i}" for i in range(100)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(100)] = f"x{rng.randint(0, 50)}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(1000 + i, "exactly the same text of seven words") for i in range(300)]
    assert found(documents(rows)) == brute(rows)


def test_odd_rows(odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == brute_by_text(rows)
    assert found(documents([])) == []


def brute_by_text(rows):
    """As brute; rows without words stay alone, with their own id."""
    linked = [r for r in rows if shingle_set(r[1])]
    alone = [(i, 0, i) for i, t in rows if not shingle_set(t)]
    return sorted([*brute(linked), *alone], key=str)


def test_one_of_each(odd, documents):
    out = jaccard.one_of_each(odd)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    kept = out.collect()
    groups = {c for i, n, c in brute_by_text(rows) if n}
    assert out.columns == odd.columns
    assert len(kept) == len(groups) + sum(not shingle_set(t) for _, t in rows)
    assert [r["doc_id"] for r in kept if r["text"] == "One two three."] == [3]
    same = documents([(5, "a b c d"), (5, "a b c d"), (5, "other words here now"), (4, "A b C d")])
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(same).collect()) == [(4, "A b C d"), (5, "other words here now")]


def test_equal_digests_of_different_sets_are_refused(documents, monkeypatch):
    docs = documents([(1, "a b c d"), (2, "e f g h")])
    join = jaccard.Join(docs)
    assert join.links.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(9, 600), st.integers(0, 10_000))
def test_similar_sets_always_share_a_signature(size, seed):
    """Sets at the edge of similarity, of all size differences."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, 2 * size + 50).astype(np.uint64))
    x = pool[:size]
    for gone in range(size // 10 + 1):
        for more in (0, size // 20, size // 9):
            y = np.concatenate([x[gone:], pool[size : size + more]])
            both = size - gone
            similar = len(y) and 10 * both >= 9 * (len(x) + len(y) - both)
            if not similar or (gone, more) == (0, 0):
                continue
            row = np.concatenate([np.zeros(len(x), np.int64), np.ones(len(y), np.int64)])
            of, sig = jaccard.signatures(row, np.concatenate([x, y]), np.array([len(x), len(y)]))
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (size, gone, more)


def test_bands_hold_partners():
    bands = jaccard.Bands()
    sizes = np.arange(9, 50_000)
    own = bands.of(sizes)
    partner = np.searchsorted(bands.starts, 10 * sizes // 9, "right") - 1
    assert (partner - own).max() <= 1
    assert all(s <= bands.largest(int(b)) for s, b in zip(sizes, own, strict=True))


def test_units_cover_all_differences():
    for largest in range(10, 5000, 7):
        twos, ones = jaccard.allocation(largest)
        assert 2 * twos + ones == jaccard.most_differences(2 * largest) + 1
    assert jaccard.allocation(14)[0] and not jaccard.allocation(500)[0]  # deletions where segments are small


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_plain_search(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    part = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in part:
        for u, v in links:
            if u != v:
                part[u] = part[v] = min(part[u], part[v])
    assert got == part
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_null_and_repeated_ids_fetch_one_text_each(documents):
    """A third of all rows without an id, a third with one id: keys differ, so a node's text is fetched once."""
    words = [f"w{i}" for i in range(40)]
    rows = [([None, 7, 1000 + i][i % 3], " ".join([*words, f"own{i // 2}"])) for i in range(120)]
    docs = documents(rows).repartition(4)
    _, _, keyed = jaccard._numbered(docs, "doc_id")
    join = jaccard.Join(keyed, "key")
    asked = join.nodes.select("node", "id")
    fetched = keyed.join(asked.select(asked["id"].alias("key"), "node"), "key")
    assert fetched.count() == asked.count() == 60
    found = jaccard.joined(docs).collect()
    assert len(found) == 120 and {r["component_id"] for r in found} == {7}
    unknown = jaccard.joined(documents([(None, "a b c d"), (None, "a b c d"), (None, None), (3, "x y z"), (None, "x y z")])).collect()
    assert sorted(map(tuple, unknown), key=str) == sorted([(None, 2, None), (None, 2, None), (None, 0, None), (3, 1, 3), (None, 1, 3)], key=str)


def test_columns_named_like_its_own_do_no_harm(documents):
    docs = documents([(1, "a b c"), (2, "a b c"), (3, "d e f")]).selectExpr("*", "5 AS __row", "6 AS __row_", "7 AS key")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["__row"]) for r in kept.collect()) == [(1, 5), (3, 5)]
