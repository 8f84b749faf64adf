from __future__ import annotations

import re
from itertools import permutations

import numpy as np

from echograph.llm import filteraudit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_hand(rows, labels):
    """Every order applied document by document."""
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [i for i, t, _ in rows if (t or "") == text and i is not None and doc_id is not None and i < doc_id]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": bool(copies),
        }
        mine = [x for x in labels if x[0] == doc_id and doc_id is not None]
        docs.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {d[0] for d in docs}:
        found = []
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = [d for d in docs if d[0] == part and d[1][f]]
                alone = [d for d in failing if sum(d[1].values()) == 1]
                found.append([part, order, step, len(left), len(gone), len(failing) - len(gone), len(alone), sum(d[2] for d in gone), sum(d[3] for d in gone)])
        total = {f: sum(r[4] for r in found if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [tuple([*r, total[r[1][r[2] - 1]]]) for r in found]
    return sorted(out)


def texts():
    plain = " ".join(f"w{i}" for i in range(60))
    return [plain, plain + " # sign", "few words", "SHOUT " + plain.upper(), "same " * 80, "same " * 80 + "&", "", None, "é\x1fÀ 中文 😀\x00" + plain, plain + " x"]


def test_every_order_by_hand(spark, documents):
    rng = np.random.default_rng(3)
    pool = texts()
    rows = [(int(i) if i else None, pool[rng.integers(len(pool))], [None, "", "a", "b"][rng.integers(4)]) for i in rng.integers(0, 60, 150)]
    labels = [(int(rng.integers(0, 60)), [None, 0, 1][rng.integers(3)], [None, 0, 1][rng.integers(3)]) for _ in range(40)] + [(None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS id", "0 AS part")
    docs = documents(rows).selectExpr("*", "0 AS part", "'d' AS digest", "7 AS bits", "true AS good", "false AS toxic")
    found = filteraudit.audited(docs, table)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == by_hand(rows, labels)


def test_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert sorted(map(tuple, filteraudit.audited(odd, labels).collect())) == by_hand(rows, [])
    assert filteraudit.audited(odd.limit(0), labels).collect() == []


def test_copies_of_one_text_are_few_rows_before_the_window(spark, documents):
    docs = documents([(i, "a copy", f"s{i % 2}") for i in range(500)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 500, 5)], "doc_id long, quality int, toxic int")
    cells = {(r["part"], r["bits"], r["good"]): r["n"] for r in filteraudit.outcomes(docs, labels).collect()}
    assert sum(cells.values()) == 500
    assert cells == {("s0", 1, True): 1, ("s0", 17, True): 49, ("s0", 17, False): 200, ("s1", 17, True): 50, ("s1", 17, False): 200}


def test_contractions_are_sums_over_axes():
    tensor = np.random.default_rng(1).integers(0, 1 << 40, (2,) * 5)
    every = filteraudit.contracted(tensor)
    assert every[2, 2, 2, 2, 2] == tensor.sum()
    assert every[0, 1, 2, 0, 1] == tensor[0, 1, :, 0, 1].sum() and every[1, 1, 1, 1, 1] == tensor[1, 1, 1, 1, 1]
    assert every.dtype == np.int64
