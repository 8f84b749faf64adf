"""Interaction counters and engagement rates of posts and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.operators.profiles import _newest_first, _ranked_first, profiles
from echograph.operators.skew import of_candidates
from echograph.schema import PROFILE_COLUMNS


#: Counters of a post that others raise.
COUNTERS = ["quote_count", "reply_count", "retweet_count"]


def _counted(posts: DataFrame) -> DataFrame:
    """Author, post and counters of each row, with ``day`` if there is one."""
    return posts.select(F.col("user.id_str").alias("user_id_str"), "id_str", *COUNTERS, *[c for c in posts.columns if c == "day"])


def _interactions(posts: DataFrame, keys: list[str], unknown_as_zero: bool = False) -> DataFrame:
    """Highest counters seen per key, added up; keys without any are left out."""
    peaks = [F.max(c) for c in COUNTERS]
    if unknown_as_zero:
        peaks = [F.coalesce(peak, F.lit(0)) for peak in peaks]
    summed = posts.groupBy(*keys).agg(sum(peaks[1:], peaks[0]).alias("interact_cnt"))
    return summed.filter(F.col("interact_cnt") > 0)


def post_interactions(posts: DataFrame, unknown_as_zero: bool = False) -> DataFrame:
    """Quotes + replies + reshares per post, where there are any.

    A post with a counter that is never known has no sum and is left out, unless
    ``unknown_as_zero`` takes it for 0.
    """
    return _interactions(_counted(posts), ["user_id_str", "id_str"], unknown_as_zero)


def counter_maxima(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.max("quote_count").alias("max_quotes"),
        F.max("reply_count").alias("max_replies"),
        F.max("retweet_count").alias("max_retweets"),
    )


def candidate_post_interactions(interactions: DataFrame, cand: DataFrame) -> DataFrame:
    return of_candidates(interactions, cand).select("user_id_str", "id_str", "interact_cnt")


def daily_post_interactions(posts: DataFrame, cand: DataFrame) -> DataFrame:
    """Per day, user and post: interactions of the candidates' posts."""
    rows = of_candidates(_counted(posts), cand)
    return _interactions(rows, ["user_id_str", "id_str", "day"])


def total_interactions(posts: DataFrame, cand: DataFrame) -> DataFrame:
    """Per candidate: the best day of every post, summed over posts.

    Candidates are kept before anything is grouped; the sum is the same.
    """
    per_post = (
        daily_post_interactions(posts, cand)
        .groupBy("user_id_str", "id_str")
        .agg(F.max("interact_cnt").alias("interact_cnt"))
    )
    return per_post.groupBy("user_id_str").agg(F.sum("interact_cnt").alias("interact_cnt"))


def _rates(posts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest profile per user with reshares summed per ``keys`` and handle.

    A handle that differs from the latest one has its reshares left out, as its
    row finds no profile.  No followers, or an unknown number, gives a null rate.
    """
    named = posts.select(
        F.col("user.id_str").alias("user_id_str"), F.col("user.screen_name").alias("user_twitter_handle"), "retweet_count", *[k for k in keys if k == "day"]
    )
    reshares = named.groupBy(*keys, "user_twitter_handle").agg(F.sum("retweet_count").alias("retweets_count"))
    rows = profiles(posts)
    first = [F.desc("day")] if "day" in keys else []
    latest = _ranked_first(rows, ["user_id_str"], *first, *_newest_first(rows, order))
    rate = F.try_divide(
        (F.col("retweets_count") + F.col("favourites_count")).cast("double"),
        F.col("followers_count").cast("double"),
    )
    return latest.join(reshares, [*keys, "user_twitter_handle"]).withColumn("ier", rate)


def engagement_rate(posts: DataFrame, cand: DataFrame | None = None, order: str = "string") -> DataFrame:
    """(reshares + favourites) / followers per user over all given posts."""
    rows = of_users(posts, cand)
    return _rates(rows, ["user_id_str"], order).select(*PROFILE_COLUMNS, "retweets_count", "ier")


def backfill_engagement_rate(posts: DataFrame, cand: DataFrame, order: str = "string") -> DataFrame:
    """Engagement rate on the newest day that has the candidate."""
    rates = _rates(of_users(posts, cand), ["day", "user_id_str"], order)
    return rates.select("day", *PROFILE_COLUMNS, "retweets_count", "ier")


def of_users(posts: DataFrame, cand: DataFrame | None) -> DataFrame:
    """Nested posts of the given users, or all of them."""
    if cand is None:
        return posts
    named = posts.withColumn("user_id_str", F.col("user.id_str"))
    return of_candidates(named, cand).drop("user_id_str")


def engagement_rate_one(posts: DataFrame, user_id: str) -> DataFrame:
    """Rate of one user over all their posts, by their highest follower count."""
    one = posts.filter(F.col("user.id_str") == F.lit(user_id)).agg(
        F.sum("retweet_count").alias("retweets"),
        F.sum("favorite_count").alias("favorites"),
        F.max("user.followers_count").alias("followers"),
    )
    rate = F.try_divide(
        (F.col("retweets") + F.col("favorites")).cast("double"), F.col("followers").cast("double")
    )
    return one.withColumn("ier", rate)


def received_interactions(pairs: DataFrame, cand: DataFrame) -> DataFrame:
    """How often others, or they themselves, refer to the candidates."""
    received = pairs.groupBy(F.col("to_user").alias("user_id_str")).agg(F.sum("n").alias("re_cnt"))
    return received.join(cand, "user_id_str", "left_semi")


def sent_and_original(rows: DataFrame, originals: DataFrame, cand: DataFrame) -> DataFrame:
    """Interaction rows and original posts per candidate that has both."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        # Counted before the join: a user is one row by then.
        return df.groupBy("user_id_str").agg(F.count(F.lit(1)).alias(name)).join(cand, "user_id_str", "left_semi")

    return counted(rows, "cnt").join(counted(originals, "ori_cnt"), "user_id_str")
