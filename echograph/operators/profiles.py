"""User profiles as seen on their posts.

Input posts are nested and may carry ``day``.  A profile row is what one post
says about its author.  "Latest" goes by the text date as a string (``string``),
which is right within a day only, so ``day`` comes before it where there is one;
or by the parsed date (``time``).  Ties keep all tied rows.

The windows filter on rank 1, which Spark applies before its shuffle as well, so
an author of a third of all posts sends one row per task, ties aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions.text import post_time
from echograph.operators.skew import of_candidates
from echograph.schema import CANDIDATE, PROFILE_COLUMNS


def profiles(posts: DataFrame) -> DataFrame:
    """One profile row per post, with ``day`` if there is one."""
    day = ["day"] if "day" in posts.columns else []
    return posts.select(
        F.col("user.id_str").alias("user_id_str"),
        F.col("user.screen_name").alias("user_twitter_handle"),
        *[F.col(f"user.{name}").alias(name) for name in PROFILE_COLUMNS[2:-1]],
        F.col("created_at").alias("tweet_created_at"),
        *day,
    )


def _post_order(rows: DataFrame, order: str) -> list[Column]:
    """What says how late a post is, most telling first."""
    if order == "string":
        return [*([F.col("day")] if "day" in rows.columns else []), F.col("tweet_created_at")]
    if order == "time":
        return [post_time(F.col("tweet_created_at"))]
    raise ValueError(f"unknown order {order!r}")


def _newest_first(rows: DataFrame, order: str) -> list[Column]:
    return [c.desc() for c in _post_order(rows, order)]


def _ranked_first(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return (
        rows.filter(F.col("user_id_str").isNotNull())
        .withColumn("create_rank", F.rank().over(window))
        .filter(F.col("create_rank") == 1)
    )


def latest_profile(posts: DataFrame, order: str = "string") -> DataFrame:
    """Profile columns of each user's latest post, with ``create_rank`` 1."""
    rows = profiles(posts)
    return _ranked_first(rows, ["user_id_str"], *_newest_first(rows, order)).select(*PROFILE_COLUMNS, "create_rank")


def user_history(posts: DataFrame, user_id: str | None = None, order: str = "string") -> DataFrame:
    """All profile rows of one user, or of every user, ranked newest first.

    ``create_rank`` is one more than the number of the user's later rows.  Rows
    are counted per user and time first, so the running sum is over different
    times, of which a day has 86,400, and no task sorts all rows of a user.
    """
    rows = profiles(posts).filter(F.col("user_id_str").isNotNull())
    if user_id is not None:
        rows = rows.filter(F.col("user_id_str") == F.lit(user_id))
    # Order-preserving, one column: dates as text sort like dates.
    at = F.struct(*[c.alias(f"at{i}") for i, c in enumerate(_post_order(rows, order))])
    rows = rows.withColumn("at", at)
    newest = Window.partitionBy("user_id_str").orderBy(F.desc("at"))
    later = (
        rows.groupBy("user_id_str", "at")
        .agg(F.count(F.lit(1)).alias("then"))
        .withColumn("later", F.sum("then").over(newest.rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("user_id_str").alias("later_user"), F.col("at").alias("later_at"), "later")
    )
    same = (F.col("user_id_str") == F.col("later_user")) & F.col("at").eqNullSafe(F.col("later_at"))
    rank = F.coalesce("later", F.lit(0)) + 1
    return rows.join(later, same).select(*PROFILE_COLUMNS, rank.cast("long").alias("create_rank"))


def posts_per_user(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.col("user.id_str").alias("user_id_str")).agg(F.count(F.lit(1)).alias("n_posts"))


def candidates(ranking: DataFrame, k: int | None = None) -> DataFrame:
    """Distinct ids of a ranking's rows: of its ``k`` best users, or of all."""
    if k is None:
        return ranking.select(F.col("users").alias("user_id_str")).distinct()
    users = ranking.groupBy("users").agg(F.max("rank").alias("rank"))
    return users.orderBy(F.desc("rank"), "users").limit(k).select(F.col("users").alias("user_id_str"))


def no_candidates(spark) -> DataFrame:
    """An empty, typed candidate list."""
    return spark.createDataFrame([], CANDIDATE)


def candidate_count(found: DataFrame) -> DataFrame:
    """How many different users a table of candidate rows holds."""
    return found.agg(F.count_distinct("user_id_str").alias("n_candidates"))


def candidate_profiles(rows: DataFrame, cand: DataFrame) -> DataFrame:
    """Rows of candidate users; see ``of_candidates`` for large lists and hot users."""
    return of_candidates(rows, cand)


def missing_candidates(cand: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates without a row in ``found``."""
    return cand.join(found.select("user_id_str"), "user_id_str", "left_anti")


def daily_profile_panel(posts: DataFrame, cand: DataFrame, order: str = "string") -> DataFrame:
    """Each candidate's latest profile of every day, as ``day`` + profile columns."""
    rows = candidate_profiles(profiles(posts), cand)
    return _ranked_first(rows, ["day", "user_id_str"], *_newest_first(rows, order)).select("day", *PROFILE_COLUMNS)


def backfill_profiles(posts: DataFrame, cand: DataFrame, order: str = "string") -> DataFrame:
    """Each candidate's latest profile of the newest day that has the candidate.

    What a newest-first loop over days finds, as one window over all days.
    """
    rows = candidate_profiles(profiles(posts), cand)
    newest = _ranked_first(rows, ["user_id_str"], F.desc("day"), *_newest_first(rows, order))
    return newest.select("day", *PROFILE_COLUMNS)
