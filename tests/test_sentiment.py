from __future__ import annotations

import math
import re

import pytest
from conftest import SF_DIR, table

from echograph.operators import sentiment as S
from echograph.plans.queries import lexicon
from echograph.sources import derived

LEX = {"good": 2.0, "bad": -1.5, "plain": 0.0}


def _lex(spark):
    return spark.createDataFrame(list(LEX.items()), "token string, valence double")


def by_hand(text, lex, alpha=15.0):
    if text is None:
        return None, None, None, None, 0
    v = [lex.get(w.lower(), 0.0) for w in re.findall("[A-Za-z]+", text)]
    total = sum(v)
    pos, neg, neu = sum(x + 1 for x in v if x > 0), sum(1 - x for x in v if x < 0), sum(1 for x in v if x == 0)
    weight = (pos + neg + neu) or 1
    compound = total / math.sqrt(total * total + alpha)
    return neg / weight, neu / weight, pos / weight, compound, int(compound >= 0)


TEXTS = ["good good day", "BAD day", "Good, bad.", "plain words", "", "!!! 123", None, "é goodé bad", "bad " * 40 + "good"]


@pytest.mark.parametrize("form", ["query", "join"])
def test_scores_by_hand_within_rows_and_by_join(spark, form):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = {r["id"]: r for r in S.sentiment_scores(df, "id", "text", _lex(spark), form=form).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert tuple(found[i][c] for c in S.SCORES) == pytest.approx(by_hand(text, LEX), nan_ok=True)


@pytest.mark.parametrize("form", ["query", "join"])
def test_equal_rows_stay_apart(spark, form):
    df = spark.createDataFrame([("a", "good"), ("a", "good"), ("a", "bad")], "id string, text string")
    scored = S.sentiment_scores(df, "id", "text", _lex(spark), form=form)
    c = [by_hand(t, LEX)[3] for t in ("good", "good", "bad")]
    row = S.sentiment_by(scored.withColumnRenamed("id", "user_id_str"), "user_id_str").first()
    assert tuple(row) == ("a", 3, 2, pytest.approx(sum(c) / 3))


def test_alpha_and_an_empty_lexicon(spark):
    df = spark.createDataFrame([(1, "good")], "id long, text string")
    assert S.sentiment_scores(df, "id", "text", _lex(spark), alpha=5.0).first()["sentiment_compound"] == pytest.approx(2 / 3)
    assert tuple(S.sentiment_scores(df, "id", "text", _lex(spark).filter("valence > 9")).first())[1:] == (0.0, 1.0, 0.0, 0.0, 1)


def test_null_texts_count_as_rows_without_a_score(spark):
    df = spark.createDataFrame([("b", None), ("b", "good")], "connected_user_single string, text string")
    scored = S.sentiment_scores(df, "connected_user_single", "text", _lex(spark))
    row = S.sentiment_by(scored, "connected_user_single").first()
    assert row.asDict() == {
        "connected_user_single": "b",
        "num_original_tweets_interacting": 2,
        "num_pos_tweets_interacting": 1,
        "avg_sentiment_compound_interacting": pytest.approx(by_hand("good", LEX)[3]),
    }


def test_whole_documents_score_alike_on_both_ways(spark):
    docs = derived.table(spark, SF_DIR, "documents")
    lex = lexicon(spark)
    ways = [S.sentiment_scores(docs, "doc_id", "text", lex, form=f) for f in ("query", "join")]
    one, other = [{r[0]: tuple(r)[1:] for r in way.collect()} for way in ways]
    assert set(one) == set(other)
    values = {r["token"]: r["valence"] for r in lex.collect()}
    for row in docs.collect():
        assert one[row["doc_id"]] == pytest.approx(by_hand(row["text"], values))
        assert other[row["doc_id"]] == pytest.approx(one[row["doc_id"]])


def test_large_lexicon_stays_a_constant(spark):
    words = [(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", float(i % 7 - 3)) for i in range(5000)]
    lex = spark.createDataFrame(words, "token string, valence double")
    df = spark.createDataFrame([(i, " ".join(w for w, _ in words[i::50])) for i in range(50)], "id long, text string")
    known = dict(words)
    for r in S.sentiment_scores(df, "id", "text", lex).collect():
        assert tuple(r)[1:] == pytest.approx(by_hand(" ".join(w for w, _ in words[r["id"]::50]), known))
    assert table(df.limit(0)) == []


def test_a_lexicon_is_checked_once_for_both_forms(spark):
    df = spark.createDataFrame([(1, "Good bad GOOD")], "id long, text string")

    def lex(*rows):
        return spark.createDataFrame(rows, "token string, valence double")

    folded = lex(("GOOD", 2.0), ("good", 2.0), ("Bad", -1.0))
    scores = [S.sentiment_scores(df, "id", "text", folded, form=f).first() for f in ("query", "join")]
    assert tuple(scores[0])[1:] == pytest.approx(by_hand("good bad good", {"good": 2.0, "bad": -1.0}))
    assert tuple(scores[1]) == pytest.approx(tuple(scores[0]))
    for wrong in (lex(("good", 2.0), ("Good", 3.0)), lex((None, 1.0)), lex(("good", None)), lex(("good", None), ("good", 1.0))):
        for form in ("query", "join"):
            with pytest.raises(ValueError):
                S.sentiment_scores(df, "id", "text", wrong, form=form)


def test_a_literal_lexicon_has_a_bound_and_never_changes_form(spark, monkeypatch):
    monkeypatch.setattr(S, "LEXICON_IN_QUERY", 2)
    df = spark.createDataFrame([(1, "good")], "id long, text string")
    with pytest.raises(ValueError):
        S.sentiment_scores(df, "id", "text", _lex(spark))
    assert S.sentiment_scores(df, "id", "text", _lex(spark), form="join").count() == 1
    with pytest.raises(ValueError):
        S.sentiment_scores(df, "id", "text", _lex(spark), form="either")


def test_large_lexicons_of_document_words_score_alike(spark):
    docs = derived.table(spark, SF_DIR, "documents")
    words = docs.selectExpr("explode(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS word").selectExpr("lower(word) AS token").distinct()
    lex = words.selectExpr("token", "CAST(pmod(hash(token), 9) - 4 AS DOUBLE) AS valence")
    assert lex.count() > 5000
    one, other = [{r[0]: tuple(r)[1:] for r in S.sentiment_scores(docs, "doc_id", "text", lex, form=f).collect()} for f in ("query", "join")]
    assert set(one) == set(other) and all(one[k] == pytest.approx(other[k]) for k in one)


def ruled_by_hand(text, lex, rules):
    words = re.findall("[A-Za-z]+", text)
    v = []
    for i, word in enumerate(words):
        x = lex.get(word.lower(), 0.0)
        before = [w.lower() for w in reversed(words[max(0, i - 3) : i])]
        more = sum(rules.boosters.get(w, 0.0) * part for w, part in zip(before, S.FADING))
        if re.search("[a-z]", text) and len(word) > 1 and word == word.upper():
            more += S.CAPITALS
        x += (x > 0) * more - (x < 0) * more
        v.append(x * (S.NEGATED if any(w in rules.negations for w in before) else 1.0))
    total = sum(v)
    pos, neg, neu = sum(x + 1 for x in v if x > 0), sum(1 - x for x in v if x < 0), sum(1 for x in v if x == 0)
    marks = min(4, text.count("!")) * S.EXCLAMATION
    total, pos, neg = total + (total > 0) * marks - (total < 0) * marks, pos + (pos > neg) * marks, neg + (neg > pos) * marks
    return neg / (pos + neg + neu), neu / (pos + neg + neu), pos / (pos + neg + neu), total / math.sqrt(total * total + 15)


def test_rules_by_hand(spark):
    texts = ["not good", "very very good day!!", "It is GOOD", "GOOD DAY", "never so very bad!!!!!!", "slightly bad, not a really good end", "good without a bad day"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rules = S.Rules()
    scored = {r["id"]: tuple(r)[1:5] for r in S.sentiment_scores(df, "id", "text", _lex(spark), rules=rules).collect()}
    for i, text in enumerate(texts):
        assert scored[i] == pytest.approx(ruled_by_hand(text, LEX, rules)), text
    empty = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert [r["sentiment_compound"] for r in S.sentiment_scores(empty, "id", "text", _lex(spark), rules=rules).orderBy("id").collect()] == [None, 0.0]
    with pytest.raises(ValueError):
        S.sentiment_scores(df, "id", "text", _lex(spark), form="join", rules=rules)
