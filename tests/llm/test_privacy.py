from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from echograph.llm import privacy
from echograph.llm import words as W
from echograph.llm.crf import Chain, train

from .conftest import ODD_TEXTS

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and privacy.luhn(digits), 9 <= len(digits) <= 15]
            if good[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_against_the_patterns():
    rng = random.Random(1)
    for signs in ("a1.@@-_+ é", "123.. a", "0123456789 -+().", "4 1-"):
        for _ in range(8000):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 24)))
            assert privacy.base_spans(text) == brute(text), text
    assert privacy.base_spans("ip 0000255.1.2.3 and 256.1.1.1") == [(3, 16, 1)]


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "a." * 200_000 + "@", "1" * 400_000, "@" * 100_000, "1." * 100_000):
        assert isinstance(privacy.base_spans(text), list)


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(2)
    vocabulary = ["the", "of", "house", "Water,", "naïve", "ends.", "it's", "(see", "below)"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 25))) for _ in range(500)]


@pytest.fixture(scope="module")
def chain(lines):
    return train(privacy.labelled_rows(lines[:400]), labels=5)


def test_held_out_accuracy(chain, lines):
    rows = privacy.labelled_rows(lines[400:], seed=99)
    texts = [" ".join(words) for words, _ in rows]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    gold = np.concatenate([marks for _, marks in rows])
    found = []
    for _, _, data, offsets in W.chunks(batch):
        starts, ends = W.runs(W.PLAIN[data], offsets)
        found.append(chain.decode(data, starts, ends, W.owner(starts, offsets)))
    found = np.concatenate(found)
    assert len(found) == len(gold)
    right = (found == gold) & (gold > 0)
    assert right.sum() >= 0.9 * (gold > 0).sum() and right.sum() >= 0.9 * (found > 0).sum()


def test_viterbi_is_the_best_path(chain):
    """Against every word decoded, without cutting the chain where it is sure."""
    text = "call (843) 555-7672 or +1 843 555 7672 x 4111 1111 1111 1111 the 10.2.3.4 house a@b.co ends."
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = W.runs(W.PLAIN[data], np.array([0, len(data)]))
    line = np.zeros(len(starts), np.int64)
    scores = chain._scores(data, starts, ends, line)
    best, back = chain.moves[0] + scores[0], []
    for t in range(1, len(starts)):
        paths = best[:, None] + chain.moves
        back.append(paths.argmax(0))
        best = paths.max(0) + scores[t]
    path = [int((best + chain.moves[:, 0]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert chain.decode(data, starts, ends, line).tolist() == path[::-1] and any(path)


def test_it_adds_what_the_patterns_miss(chain):
    texts = ["Call (843) 555-7672 now.", "Call 843.555.7672, ok", "mail a@b.org now", "on 2021-05-12 we paid 1,234.50", "plain words only here"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    found = [x for _, _, data, offsets in W.chunks(batch) for x in privacy.find(chain, data, offsets)]
    assert [(b, a) for b, a in found] == [([], [(5, 19, 3)]), ([], [(5, 17, 3)]), ([(5, 12, 0)], []), ([], []), ([], [])]


def test_rows_of_the_query(odd, chain):
    rows = privacy.personal_data(odd, chain=chain).collect()
    assert len(rows) == odd.count() and not any(r["n_card"] for r in rows)
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()} and {r["spans"] for r in rows} == {""}


def test_places_are_code_points(documents, chain):
    text = "😀 ñ é a.b@c.de 😀 +1 (843) 555-7672 x 4225039295678253 10.0.0.1 (843) 555-7672"
    docs = documents([(1, text), (1, text), (2, ODD_TEXTS[8] + " a@b.cd")])
    rows = {r["doc_id"]: r for r in privacy.personal_data(docs, chain=chain).collect()}
    base = brute(text)
    joined = ",".join(f"{privacy.KINDS[k]}:{s}:{e}" for s, e, k in base)
    assert rows[1]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["n_phone"]) == (1, 1, 1)
    assert set(joined.split(",")) <= set(rows[1]["spans"].split(","))
    assert rows[2]["n_email"] == 1


def test_training_on_the_table_itself(odd, documents):
    assert len(privacy.personal_data(odd).collect()) == odd.count()
    assert privacy.personal_data(documents([])).collect() == []
    assert privacy.personal_data(documents([(1, None), (None, "a@b.cd")])).filter("n_email = 1").count() == 1


def test_without_rows_nothing_is_labelled():
    chain = train([], labels=5)
    assert isinstance(chain, Chain)
    data = np.frombuffer(b"call 843-555-7672", np.uint8)
    assert not chain.decode(data, np.array([0, 5]), np.array([4, 17]), np.array([0, 0])).any()


def test_many_spans_are_looked_up_not_compared():
    """120,000 spans against 40,000 base spans, every third of which is touched; comparing all pairs would take hours."""
    base = [(24 * k + 2, 24 * k + 5, k % 4) for k in range(40_000)]
    labelled = [(8 * k, 8 * k + 7, 1) for k in range(120_000)]
    assert privacy.added_spans("1.2.3.4 " * 120_000, labelled, base) == [s for k, s in enumerate(labelled) if k % 3]
    assert privacy.added_spans("5.6.7.8", [(0, 7, 1)], [(0, 1, 3), (0, 2, 0)]) == []
