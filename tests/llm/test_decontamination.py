from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echograph.llm import decontamination
from echograph.llm.fmindex import FMIndex, suffix_ranks

from .conftest import ODD_TEXTS, folded

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(folded(text))


def brute(text, items):
    own = words(text)
    hit, names = set(), set()
    for name, phrase in items:
        asked = words(phrase)
        size = min(10, len(asked))
        for i in range(len(asked) - size + 1 if size else 0):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == asked[i : i + size]:
                    hit |= set(range(p, p + size))
                    names.add("" if name is None else str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit)


@pytest.fixture
def benchmark_of(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


def check(found, texts, items):
    assert len(found) == len(texts)
    for r in found:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], items), r


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_against_brute_force(documents, benchmark_of, block_words):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(8, 25))) for i in range(12)] + [(20, None), (21, "..."), (22, "Zw ZV"), (22, "zw zv"), (None, "qq"), (23, line(10))]
    texts = []
    for _ in range(120):
        text = line(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            text += " " + rng.choice([t for _, t in items if t]).upper()
        texts.append(text)
    for name, phrase in items:
        texts.append(f"start, {phrase}! {phrase}? end")
    texts += ["zw, zv qq", "zw\nzv", None, ""]
    found = decontamination.judged(documents(list(enumerate(texts))).repartition(3), benchmark_of(items), block_words=block_words).collect()
    check(found, texts, items)
    assert 10 < sum(r["contaminated"] for r in found) < len(found)


def test_odd_rows_and_empty_tables(odd, documents, benchmark_of):
    items = [(1, "one two three"), (2, None)]
    found = decontamination.judged(odd, benchmark_of(items)).collect()
    assert len(found) == odd.count() and sum(r["contaminated"] for r in found) == 3
    assert not any(r["contaminated"] for r in decontamination.judged(odd, benchmark_of([])).collect())
    assert decontamination.judged(documents([]), benchmark_of(items)).collect() == []
    assert decontamination.decontaminated(documents([]), benchmark_of(items)).collect() == []


def test_cuts_leave_no_passage(documents, benchmark_of):
    passage = " ".join(f"p{i}" for i in range(20))
    inner = " ".join(f"q{i}" for i in range(12))
    items = [(1, passage), (2, inner)]
    halves = inner.split()
    nested = " ".join(halves[:6]) + " " + passage + " " + " ".join(halves[6:])  # cutting one joins the other
    texts = [f"Before it, {passage}. After it.", nested, passage, "Clean text stays.", None, ODD_TEXTS[8]]
    docs = documents(list(enumerate(texts)))
    out = decontamination.decontaminated(docs, benchmark_of(items))
    kept = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and set(kept) == {0, 3, 4, 5}
    assert kept[0]["text"] == "Before it, \n. After it." and kept[0]["n_chars"] == len(kept[0]["text"])
    assert kept[3]["text"] == texts[3] and kept[4]["text"] is None and kept[5]["text"] == texts[5]


def test_cuts_do_not_depend_on_blocks(documents, benchmark_of):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    inner = " ".join(f"q{i}" for i in range(12))
    halves = inner.split()
    items = [(i, passage) for i in range(6)] + [(7, inner), (8, "zw zv"), (None, "zv qq")]
    texts = [" ".join(halves[:6]) + f" {passage} " + " ".join(halves[6:]), passage, f"Before. {passage}! {inner}. After.", "Clean.", None, "", "zw zv qq, é"]
    texts += [" ".join(rng.choice(["zw", "zv", "qq", "x"]) for _ in range(8)) for _ in range(40)]
    docs = documents([(i // 2, t) for i, t in enumerate(texts)]).withColumnRenamed("start", "__cut_row")  # repeated ids, a name of its own
    ways = []
    for block_words in (1_000_000, 100):
        out = decontamination.decontaminated(docs, benchmark_of(items), block_words=block_words)
        assert out.columns == docs.columns
        ways.append(sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in out.collect()))
    assert ways[0] == ways[1] and 10 < len(ways[0]) < len(texts)
    assert not any(brute(text, items)[4] for _, text, _ in ways[0])


def test_blocks_hold_all_pairs_once(documents, benchmark_of):
    """A window of many items and an item of many windows are dealt over blocks; none outgrows its share."""
    long = " ".join(f"w{i}" for i in range(3_000))
    common = "the same ten words stand in every one of these"
    items = [(0, long)] + [(i, common) for i in range(1, 3_001)] + [(1, common), (2, None)]
    blocks = decontamination.Blocks(benchmark_of(items).repartition(4), 10, 10_000)
    seen, sizes = set(), []
    for k in range(blocks.number):
        p = blocks.broadcast(k).value
        sizes.append(len(p.item_of))
        for i, (a, n) in enumerate(zip(p.starts, p.lengths, strict=True)):
            window = p.vocabulary[p.words[a : a + n]].tobytes()
            own = {(window, p.names[x]) for x in p.item_of[p.item_from[i] : p.item_from[i + 1]]}
            assert own and not own & seen
            seen |= own
    assert len(seen) == sum(sizes) == 2_991 + 3_000 and len({w for w, _ in seen}) == 2_992
    assert blocks.number >= 6 and max(sizes) < 1.3 * sum(sizes) / blocks.number


@settings(max_examples=100)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 9))
def test_index_finds_all_occurrences(text, sample):
    symbols = np.array(text, np.int64)
    full = [*text, 0]
    assert np.argsort(suffix_ranks(np.append(symbols, 0))).tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    index = FMIndex(symbols, sample)
    phrases = [tuple(text[i : i + n]) for n in (1, 2, 5) for i in range(len(text) - n + 1) if 1 not in text[i : i + n]]
    if not phrases:
        return
    lengths = np.array([len(p) for p in phrases])
    low, high = index.search(np.concatenate([np.array(p) for p in phrases]), np.cumsum(lengths) - lengths, lengths)
    for p, a, b in zip(phrases, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if tuple(text[i : i + len(p)]) == p]
