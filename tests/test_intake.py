from __future__ import annotations

import re
from datetime import date

import pytest
from conftest import SF_DIR, author, embedded, flat, post, raw, reply_to, table

from echograph.functions.terms import BROAD_TOPIC_TERMS, INTAKE_TERMS, TOPIC_TERMS
from echograph.functions.text import post_time, term_pattern
from echograph.operators import intake as I
from echograph.schema import FLAT
from echograph.sources import derived

D = date(2022, 2, 15)


def test_flat_posts_have_the_17_columns(spark):
    df = flat(
        spark,
        post(
            "1", "a", "hi", ["x", "y"],
            **reply_to("b", "9"),
            quoted_status=embedded("2", "c"),
            retweeted_status=embedded("3", "d"),
        ),
    )
    assert df.columns == FLAT.names + ["day"] and len(FLAT.names) == 17
    row = df.first().asDict()
    assert row["hashtags"] == ["x", "y"]
    assert (row["user_id_str"], row["user_twitter_handle"]) == ("a", "@a")
    assert row["in_reply_to_user_id_str"] == "b"
    assert (row["quoted_original_tweet_id_str"], row["quoted_original_user_id_str"]) == ("2", "c")
    assert (row["retweeted_original_tweet_id_str"], row["retweeted_original_user_twitter_handle"]) == ("3", "@d")


def test_embedded_posts_become_rows(spark):
    reshared = embedded("2", "b", "two", ["t"], **reply_to("z"))
    reshared["quoted_status"] = {"created_at": "c", "id_str": "4", "user": author("d")}
    posts = raw(
        spark,
        post("1", "a", "one", retweeted_status=reshared, quoted_status=embedded("3", "c", "three")),
        post("5", "e", "five"),
    )
    rows = {(r["origin"], r["id_str"]): r for r in I.unnest_embedded(posts).collect()}
    assert set(rows) == {("raw", "1"), ("raw", "5"), ("reshared", "2"), ("quoted", "3")}
    two, three = rows["reshared", "2"], rows["quoted", "3"]
    assert two["quoted_original_user_id_str"] == "d" and two["in_reply_to_user_id_str"] == "z"
    assert two["retweeted_original_user_id_str"] is None and two["user_twitter_handle"] == "@b"
    assert three["user_id_str"] == "c" and three["user_twitter_handle"] is None
    assert three["quoted_original_user_id_str"] is None and three["day"] == D


def test_keyword_filter_reads_text_and_hashtags(spark):
    df = flat(
        spark,
        post("text", "a", "a GAME of"),
        post("tag", "a", None, ["other", "Gamer"]),
        post("neither", "a", "nothing", ["none"]),
        post("no text, no tags", "a", None),
        post("no tags", "a", "nothing"),
        post("dot is literal", "a", "gXme"),
    )
    found = I.keyword_filter(df, ["game", "g.me"])
    assert table(found, "id_str", "text_hashtag") == [("tag", "other,Gamer"), ("text", "")]


def test_accented_upper_case_needs_unicode_case(spark):
    df = flat(spark, post("1", "a", "POKÉMON"), post("2", "a", "Pokémon"))
    assert table(I.keyword_filter(df, ["pokémon"]), "id_str") == [("2",)]
    assert table(I.keyword_filter(df, ["pokémon"], unicode_case=True), "id_str") == [("1",), ("2",)]


@pytest.mark.parametrize("terms", [[], [""], ["game", ""]])
def test_empty_terms_are_refused(terms):
    with pytest.raises(ValueError):
        term_pattern(terms)


def test_short_pattern_finds_what_a_plain_alternation_finds(spark):
    texts = ["legends of ARCEUS", "Pokémon", "POKÉMON", "video  games", "a-b]c^", "A-B]C^", "none", "poke mon", "twitchy", "^x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for terms in (INTAKE_TERMS, TOPIC_TERMS, ["a-b]c^", "^x", "-", "x"]):
        for unicode_case in (False, True):
            flags = "(?iu)" if unicode_case else "(?i)"
            plain = flags + "|".join(re.escape(t) for t in terms)
            short = term_pattern(terms, unicode_case)
            assert df.filter(df.text.rlike(plain) != df.text.rlike(short)).count() == 0


def test_term_lists():
    assert len(INTAKE_TERMS) == 13 and len(BROAD_TOPIC_TERMS) == 9 and len(TOPIC_TERMS) == 6
    assert set(TOPIC_TERMS) < set(BROAD_TOPIC_TERMS) < set(INTAKE_TERMS)


def test_rows_are_deduplicated_within_a_day(spark):
    same = post("1", "a", "x")
    df = flat(spark, same, same, same, day=["2022-02-15", "2022-02-15", "2022-02-16"])
    assert table(I.dedup_posts(df), "id_str", "day") == [("1", D), ("1", date(2022, 2, 16))]
    assert table(I.dedup_posts(df, "post_id"), "id_str", "day") == [("1", D)]


def test_raw_and_embedded_forms_differ_until_merged_by_id(spark):
    shown = embedded("2", "b", "two")
    posts = raw(
        spark,
        post("1", "a", "one", quoted_status=shown),
        post("3", "a", "one", retweeted_status=shown),
        post("2", "b", "two", created_at=shown["created_at"]),
    )
    rows = I.unnest_embedded(posts)
    # Raw and reshared forms of post 2 are equal; the quoted one lacks the handle.
    assert sorted(r["user_twitter_handle"] or "" for r in I.dedup_posts(rows).filter("id_str = '2'").collect()) == ["", "@b"]
    merged = I.dedup_posts(rows, "post_id")
    assert table(merged, "id_str", "user_twitter_handle") == [("1", "@a"), ("2", "@b"), ("3", "@a")]
    assert merged.columns == FLAT.names + ["day"]


def test_merging_by_id_keeps_references_and_posts_without_id(spark):
    full = post("1", "a", "x", quoted_status=embedded("9", "z", "q"))
    rows = flat(spark, post("1", "a", "x"), full, full, post(None, "b", "no id"), post(None, "b", "no id"), post(None, "c", "none"))
    kept = I.dedup_posts(rows, "post_id")
    found = [tuple(r) for r in kept.select("id_str", "quoted_original_tweet_id_str", "text").collect()]
    want = [("1", "9", "x"), (None, None, "no id"), (None, None, "no id"), (None, None, "none")]
    assert sorted(found, key=str) == sorted(want, key=str)
    earlier = flat(spark, full, post("1", "a", "x"), day=["2022-02-16", "2022-02-15"])
    assert table(I.dedup_posts(earlier, "post_id"), "day", "quoted_original_tweet_id_str") == [(D, None)]


def test_merging_by_id_sorts_no_posts(spark):
    plan = I.dedup_posts(flat(spark, post("1", "a", "x")), "post_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_counts_send_no_text(spark):
    plan = I.intake_counts(raw(spark, post("1", "a", "x")), ["x"])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("text#" in line for line in exchanges)


def test_unknown_dedup_mode(spark):
    with pytest.raises(ValueError):
        I.dedup_posts(flat(spark, post("1", "a")), "none")


def test_intake_and_its_counts_agree(spark):
    game = embedded("9", "z", "game on")
    posts = raw(
        spark,
        post("1", "a", "game"),
        post("1", "a", "game"),
        post("2", "a", "dull", retweeted_status=game),
        post("3", "b", "dull"),
        post("4", "b", "game", **reply_to("a")),
        post("5", "b", "dull"),
        day=["2022-02-15"] * 5 + ["2022-02-16"],
    )
    kept = I.intake(posts, ["game"])
    assert table(kept, "id_str") == [("1",), ("4",), ("9",)]
    counts = {(r["day"].day, r["stage"]): r["n"] for r in I.intake_counts(posts, ["game"]).collect()}
    assert [counts[15, s] for s in I.STAGES] == [5, 6, 4, 3, 1, 2]
    assert [counts[16, s] for s in I.STAGES] == [1, 1, 0, 0, 0, 0]


def test_handles_of_authors_and_replied_users(spark):
    df = flat(
        spark,
        post("1", "a", user={"screen_name": "old"}),
        post("2", "a", user={"screen_name": "new"}, **reply_to("b")),
        post("3", "a", user={"screen_name": "new"}),
        post("4", "c", user={"screen_name": None}),
    )
    assert table(I.handle_dictionary(df)) == [("a", "new"), ("a", "old"), ("b", "@b")]


def test_text_dates_parse(spark):
    df = spark.createDataFrame([("Tue Feb 15 01:02:03 +0000 2022",), ("Tue Feb 15 01:02:03 +0200 2022",), ("bad",), (None,)], "c string")
    found = [r[0] and r[0].strftime("%F %T") for r in df.select(post_time(df.c)).collect()]
    assert found == ["2022-02-15 01:02:03", "2022-02-14 23:02:03", None, None]


def test_flat_form_of_the_tables_equals_flattened_posts(spark):
    nested = I.flatten_posts(derived.posts(spark, SF_DIR))
    direct = derived.flat_posts(spark, SF_DIR)
    assert nested.columns == direct.columns
    assert table(nested) == table(direct)


@pytest.mark.parametrize("mode", ["row_per_day", "post_id"])
def test_dedup_moves_rows_without_their_texts(spark, mode):
    """2,000 different posts of one text: rows travel without it."""
    rows = flat(spark, post("0", "a", "x")).drop("id_str").crossJoin(spark.range(2000).selectExpr("CAST(id AS STRING) AS id_str"))
    df = rows.select(*FLAT.names, "day")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        text = I.dedup_posts(df.unionByName(df), mode)._jdf.queryExecution().explainString(formatted)
        moved = [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]
        found = table(I.dedup_posts(df.unionByName(df), mode))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("text" in columns for columns in moved)
    # With a text goes only what it is found by.
    assert all("user_id_str" not in columns for columns in moved if "text" in columns)
    assert found == table(df)


@pytest.mark.parametrize("mode", ["row_per_day", "post_id"])
def test_dedup_tells_empty_and_unknown_texts_apart(spark, mode):
    df = flat(spark, post("1", "a", ""), post("2", "a", None), post("3", "a", "x"), post("3", "a", "x"), post("4", "a", None), post("4", "a", None))
    assert table(I.dedup_posts(df, mode), "id_str", "text") == [("1", ""), ("2", None), ("3", "x"), ("4", None)]
    assert table(I.dedup_posts(df.drop("text"), mode), "id_str") == [("1",), ("2",), ("3",), ("4",)]


def test_rows_get_the_texts_of_their_keys(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", None), ("4", "none"), ("5", "b"), ("6", None)], "id_str string, text string")
    texts = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y")], "text_key string, text string")
    assert table(I.with_texts(rows, texts)) == [("1", "x"), ("2", "x"), ("3", None), ("4", None), ("5", ""), ("6", None)]
    assert I.with_texts(rows, texts).columns == rows.columns


def test_rows_without_a_key_are_dealt_evenly(spark):
    rows = spark.range(8000).selectExpr("CAST(id AS STRING) AS id_str", "IF(id < 10, CAST(id AS STRING), NULL) AS text")
    texts = spark.range(10).selectExpr("CAST(id AS STRING) AS text_key", "concat('text ', id) AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = I.with_texts(rows, texts).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 8000 and max(sizes) < 2000
