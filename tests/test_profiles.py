from __future__ import annotations

from datetime import date

import pytest
from conftest import post, raw, table

from echograph.operators import engagement as E
from echograph.operators import profiles as P

TUE, WED = "Tue Feb 15 01:02:03 +0000 2022", "Wed Feb 16 01:02:03 +0000 2022"
FRI, SAT = "Fri Feb 18 09:00:00 +0000 2022", "Sat Feb 19 08:00:00 +0000 2022"


def _at(id_str, user, created_at, handle=None, followers=10, **more):
    return post(id_str, user, created_at=created_at, user={"screen_name": handle or user, "followers_count": followers}, **more)


def test_latest_by_string_and_by_time_differ_across_weekdays(spark):
    posts = raw(spark, _at("1", "a", WED, followers=1), _at("2", "a", FRI, followers=2))
    assert table(P.latest_profile(posts), "followers_count", "create_rank") == [(1, 1)]
    assert table(P.latest_profile(posts, "time"), "followers_count", "create_rank") == [(2, 1)]


def test_ties_keep_all_rows_and_users_without_id_go(spark):
    posts = raw(
        spark, _at("1", "a", TUE, "x"), _at("2", "a", TUE, "y"), post("3", "n", user={"id_str": None}), _at("4", "b", TUE)
    )
    assert table(P.latest_profile(posts), "user_id_str", "user_twitter_handle") == [("a", "x"), ("a", "y"), ("b", "b")]


@pytest.mark.parametrize("order", ["string", "time"])
def test_history_ranks_all_rows_with_gaps(spark, order):
    stamps = [
        "Tue Feb 15 01:02:03 +0000 2022", "Tue Feb 15 01:02:03 +0000 2022", "Tue Feb 15 01:02:04 +0000 2022",
        "Tue Feb 15 02:00:00 +0000 2022", "Tue Feb 15 23:00:00 +0000 2022",
    ]
    posts = raw(spark, *[_at(str(i), "a", c, followers=i) for i, c in enumerate(stamps)], _at("9", "b", TUE, followers=9))
    assert table(P.user_history(posts, "a", order), "followers_count", "create_rank") == [
        (0, 4), (1, 4), (2, 3), (3, 2), (4, 1),
    ]
    assert len(table(P.user_history(posts, order=order))) == 6


def test_strings_go_by_day_first(spark):
    stamps = {"2022-02-15": TUE, "2022-02-16": WED, "2022-02-18": FRI, "2022-02-19": SAT}
    posts = raw(spark, *[_at(str(i), "a", c, followers=i) for i, c in enumerate(stamps.values())], day=list(stamps))
    for order in ("string", "time"):
        assert table(P.latest_profile(posts, order), "followers_count", "create_rank") == [(3, 1)]
        assert table(P.user_history(posts, order=order), "followers_count", "create_rank") == [(0, 4), (1, 3), (2, 2), (3, 1)]
        assert table(E.engagement_rate(posts, order=order), "followers_count") == [(3,)]


def test_history_of_unreadable_dates(spark):
    posts = raw(spark, *[_at(str(i), "a", None, followers=i) for i in range(3)], _at("4", "a", TUE, followers=4))
    for order in ("string", "time"):
        assert table(P.user_history(posts, order=order), "followers_count", "create_rank") == [(0, 2), (1, 2), (2, 2), (4, 1)]


def test_unknown_order(spark):
    with pytest.raises(ValueError):
        P.latest_profile(raw(spark, _at("1", "a", TUE)), "newest")


def test_candidates(spark):
    ranking = spark.createDataFrame(
        [("a", 0.5, "x"), ("a", 0.5, "y"), ("b", 0.2, None), ("c", 0.2, None)], "users string, rank double, user_twitter_handle string"
    )
    assert table(P.candidates(ranking)) == [("a",), ("b",), ("c",)]
    assert table(P.candidates(ranking, 2)) == [("a",), ("b",)]


def _cand(spark, *users):
    return spark.createDataFrame([(u,) for u in users], "user_id_str string")


def _days(spark):
    return raw(
        spark,
        _at("1", "a", TUE, "a1", retweet_count=1),
        _at("2", "a", WED, "a2", retweet_count=2),
        _at("3", "a", "Wed Feb 16 02:00:00 +0000 2022", "a3", retweet_count=3),
        _at("4", "b", TUE, "b1", followers=0, retweet_count=4),
        _at("5", "c", WED, "c1", retweet_count=5),
        day=["2022-02-15", "2022-02-16", "2022-02-16", "2022-02-15", "2022-02-16"],
    )


def test_panel_keeps_every_day_and_backfill_the_newest(spark):
    posts, cand = _days(spark), _cand(spark, "a", "b", "z")
    d15, d16 = date(2022, 2, 15), date(2022, 2, 16)
    panel = P.daily_profile_panel(posts, cand)
    assert table(panel, "day", "user_twitter_handle") == [(d15, "a1"), (d15, "b1"), (d16, "a3")]
    found = P.backfill_profiles(posts, cand)
    assert table(found, "day", "user_twitter_handle") == [(d15, "b1"), (d16, "a3")]
    missing = P.missing_candidates(cand, found)
    assert table(missing) == [("z",)]
    assert {r[0] for r in table(missing)} | {r[0] for r in table(found, "user_id_str")} == {"a", "b", "z"}
    assert P.candidate_count(panel).first()[0] == 2


def test_no_candidates_give_empty_typed_results(spark):
    posts, none = _days(spark), P.no_candidates(spark)
    assert table(P.backfill_profiles(posts, none)) == []
    assert P.backfill_profiles(posts, none).columns[:2] == ["day", "user_id_str"]
    assert table(E.total_interactions(posts, none)) == table(P.missing_candidates(none, P.profiles(posts))) == []


def test_backfill_equals_a_loop_over_days(spark):
    posts, left, found = _days(spark), {"a", "b", "z"}, []
    for day in ("2022-02-16", "2022-02-15"):
        rows = P.candidate_profiles(P.latest_profile(posts.filter(f"day = '{day}'")), _cand(spark, *left))
        rows = table(rows, "user_id_str", "user_twitter_handle")
        found += rows
        left -= {r[0] for r in rows}
    assert sorted(found) == table(P.backfill_profiles(posts, _cand(spark, "a", "b", "z")), "user_id_str", "user_twitter_handle")


def test_posts_per_user(spark):
    assert table(P.posts_per_user(_days(spark))) == [("a", 3), ("b", 1), ("c", 1)]


def test_engagement_rate(spark):
    rates = E.engagement_rate(_days(spark))
    assert table(rates, "user_id_str", "user_twitter_handle", "retweets_count", "ier") == [
        ("a", "a3", 3, 0.8), ("b", "b1", 4, None), ("c", "c1", 5, 1.0),
    ]
    of_a = E.engagement_rate(_days(spark), _cand(spark, "a"))
    assert table(of_a, "user_id_str", "ier") == [("a", 0.8)]


def test_engagement_rate_sums_one_handle_over_posts(spark):
    posts = raw(spark, _at("1", "a", TUE, retweet_count=1), _at("2", "a", WED, retweet_count=2, followers=None))
    assert table(E.engagement_rate(posts), "retweets_count", "ier") == [(3, None)]


def test_backfilled_engagement_uses_one_day_only(spark):
    rates = E.backfill_engagement_rate(_days(spark), _cand(spark, "a", "b"))
    assert table(rates, "day", "user_id_str", "retweets_count", "ier") == [
        (date(2022, 2, 15), "b", 4, None), (date(2022, 2, 16), "a", 3, 0.8),
    ]


def test_engagement_rate_of_one_user(spark):
    posts = raw(
        spark,
        _at("1", "a", TUE, followers=10, retweet_count=1, favorite_count=2),
        _at("2", "a", WED, followers=20, retweet_count=3, favorite_count=4),
        _at("3", "b", WED, followers=99, retweet_count=9),
    )
    assert table(E.engagement_rate_one(posts, "a")) == [(4, 6, 20, 0.5)]
    assert table(E.engagement_rate_one(posts, "nobody")) == [(None, None, None, None)]


def _counted(id_str, user, q, r, t):
    return post(id_str, user, quote_count=q, reply_count=r, retweet_count=t)


def test_interactions_take_the_best_of_each_counter_within_a_day(spark):
    posts = raw(
        spark,
        _counted("1", "a", 1, 0, 5),
        _counted("1", "a", 2, 1, 3),
        _counted("2", "a", 0, 0, 0),
        _counted("3", "b", None, 1, 1),
        _counted("4", "c", 0, 1, 0),
    )
    found = E.post_interactions(posts)
    assert table(found) == [("a", "1", 8), ("c", "4", 1)]
    assert table(E.candidate_post_interactions(found, _cand(spark, "a", "z"))) == [("a", "1", 8)]
    assert table(E.counter_maxima(posts)) == [(2, 1, 5)]
    assert table(E.post_interactions(posts, unknown_as_zero=True)) == [("a", "1", 8), ("b", "3", 2), ("c", "4", 1)]


def test_totals_take_the_best_day_of_each_post(spark):
    posts = raw(
        spark,
        _counted("1", "a", 5, 0, 0),
        _counted("1", "a", 0, 0, 4),
        _counted("1", "a", 0, 3, 3),
        _counted("2", "a", 1, 1, 1),
        _counted("9", "b", 1, 1, 1),
        day=["2022-02-15", "2022-02-16", "2022-02-16", "2022-02-15", "2022-02-15"],
    )
    # Post 1: 5 on the first day, 3 + 4 on the second.
    assert table(E.total_interactions(posts, _cand(spark, "a"))) == [("a", 10)]


def test_received_and_sent(spark):
    from conftest import pairs

    found = pairs(spark, ("a", "b", 2), ("c", "b", 3), ("b", "b", 1), ("b", "x", 1))
    assert table(E.received_interactions(found, _cand(spark, "b", "a"))) == [("b", 6)]
    rows, originals = _cand(spark, "a", "a", "b", "c"), _cand(spark, "a", "c", "c", "d")
    assert table(E.sent_and_original(rows, originals, _cand(spark, "a", "b", "c"))) == [("a", 2, 1), ("c", 1, 2)]
