"""User-to-user interaction graph: A -> B when A reshares, quotes or answers B."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograph.functions.text import joined_tags
from echograph.operators.intake import keyword_filter
from echograph.operators.skew import balanced_join, heavy_keys
from echograph.schema import HANDLE_COLUMNS, INTERACTION_ROW, ORIGINAL_ROW
from echograph.sources.tables import stored


def _references() -> list[Column]:
    """Users a post refers to, in the order quoted, replied to, reshared."""
    return [
        F.col("quoted_original_user_id_str"),
        F.col("in_reply_to_user_id_str"),
        F.col("retweeted_original_user_id_str"),
    ]


def _without_handles(posts: DataFrame) -> DataFrame:
    """The columns kept between stages: ids, text and the joined hashtags."""
    if "text_hashtag" not in posts.columns:
        posts = posts.withColumn("text_hashtag", joined_tags(F.col("hashtags")))
    return posts.drop(*HANDLE_COLUMNS, "hashtags")


def connected_users(posts: DataFrame) -> DataFrame:
    """Posts without handles, with the users they refer to as array ``connected``.

    A user referred to twice by one post is in the array twice.
    """
    return _without_handles(posts).withColumn("connected", F.array_compact(F.array(*_references())))


def interaction_rows(posts: DataFrame) -> DataFrame:
    """One row per post and user referred to, in ``connected_user_single``.

    Equals exploding ``connected_users`` where the array is not empty, but the
    array never leaves generated code.
    """
    exploded = _without_handles(posts).select(
        "*", F.explode(F.array(*_references())).alias("connected_user_single")
    )
    return exploded.filter(F.col("connected_user_single").isNotNull())


def connected_posts(posts: DataFrame) -> DataFrame:
    """Posts that refer to anyone, one row each; what ``interaction_rows`` explodes."""
    return posts.filter(F.coalesce(*_references()).isNotNull())


def original_posts(posts: DataFrame) -> DataFrame:
    """Posts that refer to no one; with ``interaction_rows`` this covers all."""
    return _without_handles(posts).filter(F.coalesce(*_references()).isNull())


def interactions_per_user(rows: DataFrame) -> DataFrame:
    """How often each author refers to anyone, self references included."""
    return rows.groupBy("user_id_str").agg(F.count(F.lit(1)).alias("n"))


def interactions_per_pair(rows: DataFrame) -> DataFrame:
    """How often each author refers to each user, as ``from_user, to_user, n``."""
    return rows.groupBy(
        F.col("user_id_str").alias("from_user"), F.col("connected_user_single").alias("to_user")
    ).agg(F.count(F.lit(1)).alias("n"))


def edge_weights(pairs: DataFrame, kind: str = "ratio") -> DataFrame:
    """Weighted edges without self-loops.

    ``count``: the pair count.  ``ratio``: the pair's share in all interactions
    of its author.  Self references count in that total, so an author's weights
    sum to at most 1.  One aggregate per author gives totals and hot authors, so
    ``pairs`` is read twice: pass a stored table.  An author with a large share
    of all pairs is split over tasks.
    """
    if kind == "count":
        weighted = pairs.withColumn("weight", F.col("n").cast("double"))
    elif kind == "ratio":
        per_author = pairs.groupBy("from_user").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
        per_author = stored(per_author, "totals")
        heavy = heavy_keys(per_author, "from_user")
        joined = balanced_join(pairs, per_author.drop("rows"), "from_user", "to_user", heavy)
        weighted = joined.withColumn("weight", F.col("n").cast("double") / F.col("total").cast("double"))
    else:
        raise ValueError(f"unknown weight kind {kind!r}")
    return weighted.filter(F.col("from_user") != F.col("to_user")).select("from_user", "to_user", "weight")


def topic_edges(rows: DataFrame, terms: Sequence[str], unicode_case: bool = False) -> DataFrame:
    """Count-weighted edges of the interaction rows that mention ``terms``.

    Equal rows collapse first, over all days: two references of one post to one
    user count once here.  The text goes by its 256-bit digest, so none travels.
    """
    matched = keyword_filter(rows, terms, tags="text_hashtag", unicode_case=unicode_case)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text")
    distinct_rows = matched.select(*[digest if c == "text" else c for c in INTERACTION_ROW.names]).distinct()
    return edge_weights(interactions_per_pair(distinct_rows), "count")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """All endpoints of the edges, once each."""
    return edges.select(F.explode(F.array("from_user", "to_user")).alias("users")).distinct()


def strongest_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest edges; ties go by the ids."""
    return edges.orderBy(F.desc("weight"), "from_user", "to_user").limit(k)


def intermediate_rows(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(original, interaction)`` rows in the columns stored between stages."""
    return (
        original_posts(posts).select(*ORIGINAL_ROW.names),
        interaction_rows(posts).select(*INTERACTION_ROW.names),
    )
