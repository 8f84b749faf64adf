"""The pipeline's stages against plain Python over a small table with every kind of document."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from echograph.llm import mixing
from echograph.llm.shipping import importable

from . import test_decontamination, test_jaccard
from .conftest import SF_DIR, plain_words

PASSAGE = " ".join(f"secretword{i}" for i in range(25))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    importable(spark)
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(n)).capitalize() + "."
    texts = ["\n".join(line(rng.randint(8, 20)) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts += [texts[1], texts[1], texts[2].replace(" ", "  "), texts[3] + " And more at its end."]  # copies
    texts += [None, "", "too short.", "Nav | a | b | c | d\n" * 5 + line(9), "spam " * 50 + "."]  # junk
    texts += [f"{texts[9]}\n{PASSAGE.capitalize()}.\n{texts[10]}"]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "never there " * 9)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Rows after each stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        result = stage(spark, docs, folder)
        if k < 4:
            assert result.columns == docs.columns
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_rules(stages):
    kept = {r["doc_id"] for r in stages[1]}
    assert kept == {r["doc_id"] for r in stages[0]} - {64, 65, 66, 67, 68}


def test_one_document_of_each_group_stays(stages):
    want = {c for _, _, c in test_jaccard.brute([(r["doc_id"], r["text"]) for r in stages[1]])}
    assert {r["doc_id"] for r in stages[2]} == want and len(stages[2]) == len(want) < len(stages[1])


def test_passages_go_and_clean_texts_stay(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2]}
    assert {r["doc_id"] for r in stages[3]} == set(before)
    for r in stages[3]:
        assert not test_decontamination.brute(r["text"], [(1, PASSAGE)])[-1]
        assert r["text"] == before[r["doc_id"]] or r["doc_id"] == 69
        assert r["n_chars"] == len(r["text"])


def test_the_mix_meets_its_targets(stages):
    sizes, taken = {}, {}
    for rows, into in ((stages[3], sizes), (stages[4], taken)):
        for r in rows:
            into[r["source"]] = into.get(r["source"], 0) + len(plain_words(r["text"]))
    names = [*sorted(s for s in sizes if s is not None), None]
    for name, target in zip(names, mixing.fill_targets([sizes[s] for s in names], [3, 1, 2], 1.5), strict=True):
        assert abs(taken[name] - target) <= 3
    assert max(sum(r["doc_id"] == x["doc_id"] for x in stages[4]) for r in stages[4]) <= 2


def test_tokens_of_what_is_left(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r, want in zip(sorted(stages[5], key=lambda r: r["start"]), sorted(stages[4], key=lambda r: r["doc_id"]), strict=True):
        ids = np.array([*tokenizer.encode(want["text"], add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_is_the_stages_in_turn(spark, folder, stages):
    assert sorted(map(tuple, pipeline.run(spark, folder).collect())) == sorted(map(tuple, stages[5]))
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_given_tables(spark):
    assert pipeline.run(spark, SF_DIR).count() > 100


def test_empty_table(spark, documents, folder):
    docs = documents([], extra=False)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
