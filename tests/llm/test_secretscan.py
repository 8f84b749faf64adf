from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from echograph.llm import secretscan

from .conftest import ODD_TEXTS

LINES = [f"the water of house number {i} is near the river and the old mill" for i in range(40)]


@pytest.fixture(scope="module")
def language():
    return secretscan.Language({"the": 50, "water": 20, "house": 20, "river": 9, "number": 9, "button": 3, "primary": 3})


def test_held_out_accuracy(spark, language):
    findings = secretscan.labelled_findings(LINES * 15, language)
    model = secretscan.train(spark, findings)
    held = secretscan.labelled_findings(LINES * 8, language, seed=77)
    table = spark.createDataFrame(held, "features array<double>, label int").withColumn("vector", array_to_vector("features"))
    rows = model.transform(table).select("label", "prediction").collect()
    right = np.mean([r["label"] == r["prediction"] for r in rows])
    assert right > 0.9 and {r["label"] for r in rows} == {0, 1}


def test_candidates():
    text = 'a token = "abcdefghijklmnopqrst" and abcdefghijklmnopqrst, id 1234567890abcdef1 short1'
    assert [text[a:b] for a, b in secretscan.candidates(text)] == ["abcdefghijklmnopqrst", "1234567890abcdef1"]


def test_features_tell_words_from_keys(language):
    words = secretscan.features(language, "waterhouseriverwater1", 0, 21, None)
    key = secretscan.features(language, "x9Qz7Kp2Lm4Vt8Bw3Rn6", 0, 20, "app/config.yml")
    assert words[11] > 0.9 and key[11] == 0 and words[10] > key[10] and key[-1] == 1 and words[-1] == 0


def test_dictionary_counts_everything(documents):
    docs = documents([(i, "alpha beta alpha") for i in range(30)] + [(99, "gamma"), (100, None), (101, "éalpha ab")])
    assert secretscan.dictionary(docs, share=20) == {"alpha": 61, "beta": 30}
    assert secretscan.dictionary(docs, share=1000) == {"alpha": 61, "beta": 30, "gamma": 1}
    assert secretscan.dictionary(documents([])) == {}


def test_planted_secrets_are_kept_and_others_removed(documents):
    rng = np.random.default_rng(3)
    rows, secret = [], set()
    for i in range(60):
        if i % 3 == 0:
            rows.append((i, f'{LINES[i % 40]}\ntoken = "{rng.bytes(20).hex()}" here'))
            secret.add(i)
        elif i % 3 == 1:
            rows.append((i, f"{LINES[i % 40]} card {rng.integers(10**15, 10**16)} and sha256 {rng.bytes(32).hex()}"))
        else:
            rows.append((i, LINES[i % 40]))
    found = secretscan.scored(documents(rows)).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(60) if i % 3 != 2}
    assert {r["doc_id"] for r in found if r["is_secret"]} == secret


def test_odd_rows(odd, documents):
    assert secretscan.scored(odd).collect() == []
    assert secretscan.scored(documents([])).collect() == []
    key = "0123456789abcdef0123"
    docs = documents([(1, f"naïve 中 {key}", None), (1, f"naïve 中 {key}", None), (None, ODD_TEXTS[8] + f' key="{key}"', "a")])
    rows = secretscan.scored(docs).collect()
    assert sorted((str(r["doc_id"]), r["end"] - r["start"]) for r in rows) == [("1", 20), ("1", 20), ("None", 20)]
    assert {r["start"] for r in rows if r["doc_id"] == 1} == {8}


def slow_candidates(text):
    """The definition, place by place."""
    run = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    spans = set()
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in run:
            end += 1
        if end - at >= 16:
            before = text[max(0, at - 6) : at]
            quoted = before[-1:] in ("'", '"') and before[:-1].rstrip()[-1:] in ("=", ":") and len(before[:-1]) - len(before[:-1].rstrip()) <= 3
            if any("0" <= c <= "9" for c in text[at:end]) or quoted:
                spans.add((at, end))
        at = max(end, at + 1)
    names = ("key", "token", "secret", "password", "passwd", "passphrase", "pwd", "auth", "credential", "credentials")
    for at, sign in enumerate(text):
        if sign in "=:":
            before = text[max(0, at - 48) : at]
            bare = before.rstrip()
            bare = bare[:-1] if bare[-1:] in ("'", '"') else bare
            word = bare[len(bare.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")) :].lower()
            if len(before) - len(before.rstrip()) <= 3 and any(word.rfind(n) >= 0 and len(word) - word.rfind(n) - len(n) <= 16 for n in names):
                for skip in range(4):
                    if not text[at + 1 : at + 1 + skip].isspace() and skip:
                        break
                    start = at + 1 + skip
                    quote = text[start : start + 1]
                    if quote in ("'", '"') and quote:
                        end = start + 1
                        while end < len(text) and text[end] != quote and not text[end].isspace():
                            end += 1
                        if end < len(text) and text[end] == quote and end - start > 6:
                            spans.add((start + 1, end))
                    else:
                        end = start
                        while end < len(text) and text[end] not in "\"',;<>()" and not text[end].isspace():
                            end += 1
                        if end - start >= 6:
                            spans.add((start, end))
            if text.startswith("://", at):
                user = at + 3
                while user < len(text) and text[user] not in "/:@" and not text[user].isspace():
                    user += 1
                end = user + 1
                while end < len(text) and text[end] not in "/@" and not text[end].isspace():
                    end += 1
                if user > at + 3 and text[user : user + 1] == ":" and end > user + 1 and text[end : end + 1] == "@":
                    spans.add((user + 1, end))
    return sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))


def test_candidates_by_brute_force():
    rng = np.random.default_rng(4)
    parts = ["password", "PWD", "api_key", "token_of_mine", " = ", ": ", "=", ":", '"', "'", " ", "\n", "Tr0ub4dor&3", "s3cr3t!", "abc", "0123456789abcdef01", "https://", "bob", "@host", "/", "é中", "x" * 17, ",", "note", "a1b2c3d4e5f6a7b8c9"]
    for _ in range(4000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(1, 14))))
        assert secretscan.candidates(text) == slow_candidates(text), text


def test_short_passwords_logins_and_letter_tokens_reach_the_forest():
    text = "password = 'Tr0ub4dor&3'\ndb: postgres://bob:hunter22@db.host/x\ntoken: abcdefghijklmnopqrst\nnothing: here"
    assert [text[a:b] for a, b in secretscan.candidates(text)] == ["Tr0ub4dor&3", "hunter22", "abcdefghijklmnopqrst"]


def test_recall_on_planted_secrets(documents):
    """Secrets and look-alikes of other seeds than the forest has seen, in whole documents."""
    rng = np.random.default_rng(2024)
    rows, truth = [], {}
    for i in range(400):
        before, value, after, label = secretscan.written_finding(rng)
        rows.append((i, f"{LINES[i % 40]}\n{LINES[(i * 7) % 40]} {before}{value}{after} {LINES[(i * 3) % 40]}"))
        truth[i] = label
    found = {r["doc_id"] for r in secretscan.scored(documents(rows)).collect() if r["is_secret"]}
    secrets = {i for i, label in truth.items() if label}
    assert len(found & secrets) >= 0.9 * len(secrets) and len(found & secrets) >= 0.9 * len(found)


def test_one_huge_run_of_letters_costs_its_length(language):
    """Also where the run itself is the corpus."""
    run = "abc" * 200_000
    text = f'key = "{run}1"'
    own = secretscan.Language({"abc" * 13: 5, "abcabc": 3, **{w: 1 for w in language.words}})
    assert secretscan.candidates(text) == [(7, 7 + len(run) + 1)]
    assert own.covered(run) > 0.99


def test_words_of_the_dictionary_are_bounded(documents):
    assert secretscan.dictionary(documents([(1, "x" * 100_000), (2, "word word " + "y" * 41 + " " + "z" * 40)])) == {"word": 2, "z" * 40: 1}
