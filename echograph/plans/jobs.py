"""Whole jobs: from day folders to result folders.

Each job keeps what several outputs share as a parquet table, writes the files
the next job reads, and leaves nothing else behind.  Locations are parameters;
any file system Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.operators import engagement, graph, intake, profiles, ranking, sentiment
from echograph.schema import HANDLE, INTERACTION_ROW, ORIGINAL_ROW, PAIR, RANKED
from echograph.sources.posts import bad_lines, lost_files, read_days, split_days
from echograph.sources.tables import job_folder, read_csv, read_json, stored, write_csv, write_json


def _by_day(df: DataFrame, path: str) -> DataFrame:
    """Write as parquet partitioned by ``day`` and read back; rows are written where they are, a file for each day of a partition."""
    df.write.mode("overwrite").partitionBy("day").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def intake_job(
    spark: SparkSession,
    template: str,
    days: Iterable[str],
    terms: Sequence[str],
    out: str,
    dedup: str = "row_per_day",
    unicode_case: bool = False,
    skip_corrupt: bool = False,
) -> list[str]:
    """Day folders to posts, handles, intermediate rows, pair and user counts.

    The archive is scanned once for the ``posts`` table, from which everything
    else comes, and once for the report: rows after each stage, broken lines and
    days without files, per day.  A file that cannot be read fails the job,
    unless ``skip_corrupt`` leaves the rest of it out: the report then counts such
    files, and ``lost`` lists them.  Returns the days that had no files.
    """
    found, skipped = split_days(spark, template, days)
    read = read_days(spark, template, found, skip_corrupt=skip_corrupt)
    posts = _by_day(intake.intake(read, terms, dedup, unicode_case), f"{out}/posts")
    broken = bad_lines(spark, template, found, skip_corrupt=skip_corrupt)
    lost = lost_files(spark, template, found) if skip_corrupt else None
    if lost is not None:
        write_csv(lost, f"{out}/lost", header=True)
    write_csv(intake.intake_report(intake.intake_counts(read, terms, unicode_case), broken, skipped, lost), f"{out}/report")
    write_csv(intake.handle_dictionary(posts), f"{out}/handles", header=True)
    original, connected = graph.intermediate_rows(posts)
    write_json(original, f"{out}/original")
    write_json(connected, f"{out}/connected")
    rows = graph.interaction_rows(posts)
    write_csv(graph.interactions_per_pair(rows), f"{out}/pairs")
    write_csv(graph.interactions_per_user(rows), f"{out}/users")
    return skipped


def read_handles(spark: SparkSession, out: str) -> DataFrame:
    return read_csv(spark, f"{out}/handles", HANDLE, header=True)


def ranking_job(
    spark: SparkSession, data: str, out: str, k: int = 10, rounds: int = 10, neighbours: bool = False
) -> DataFrame:
    """Pair counts to the ``k`` top users by influence rank, or by PageRank
    (``neighbours``), written without header as id, rank, handle."""
    with job_folder(spark):
        edges = graph.edge_weights(stored(read_csv(spark, f"{data}/pairs", PAIR), "pairs"))
        rank = ranking.pagerank(stored(edges, "edges"), rounds) if neighbours else ranking.influence_rank(edges, rounds)
        write_csv(ranking.top_influencers(rank, read_handles(spark, data), k), out)
    return read_csv(spark, out, RANKED)


def hits_job(
    spark: SparkSession,
    data: str,
    out: str,
    terms: Sequence[str] | None = None,
    rounds: int = 10,
    norm: str = "l2",
    k: int = 200,
    unicode_case: bool = False,
) -> None:
    """Top authorities and hubs, of interaction rows on ``terms`` or of all pairs."""
    with job_folder(spark):
        if terms is None:
            edges = graph.edge_weights(read_csv(spark, f"{data}/pairs", PAIR), "count")
        else:
            edges = graph.topic_edges(read_json(spark, f"{data}/connected", INTERACTION_ROW), terms, unicode_case)
        auth, hub = ranking.hits(stored(edges, "edges"), rounds, norm)
        handles = read_handles(spark, data)
        write_csv(ranking.top_nodes(auth, handles, k), f"{out}/authorities")
        write_csv(ranking.top_nodes(hub, handles, k), f"{out}/hubs")


def profile_job(
    spark: SparkSession,
    template: str,
    days: Iterable[str],
    data: str,
    ranked: str,
    out: str,
    order: str = "string",
) -> None:
    """Everything about the users of a ranking.

    The archive is scanned once, for the posts of these users only.
    """
    with job_folder(spark):
        cand = stored(profiles.candidates(read_csv(spark, ranked, RANKED)), "candidates")
        posts = read_days(spark, template, days).select(
            "created_at", "id_str", "user", "quote_count", "reply_count", "retweet_count", "favorite_count", "day"
        )
        posts = stored(engagement.of_users(posts, cand), "candidate-posts")
        rates = engagement.backfill_engagement_rate(posts, cand, order)
        write_csv(profiles.daily_profile_panel(posts, cand, order), f"{out}/panel")
        write_csv(rates, f"{out}/engagement")
        write_csv(profiles.missing_candidates(cand, rates), f"{out}/missing")
        write_csv(engagement.daily_post_interactions(posts, cand).drop("day"), f"{out}/post_interactions")
        write_csv(engagement.total_interactions(posts, cand), f"{out}/total_interactions")
        write_csv(
            engagement.received_interactions(read_csv(spark, f"{data}/pairs", PAIR), cand), f"{out}/received"
        )
        write_csv(
            engagement.sent_and_original(
                read_json(spark, f"{data}/connected", INTERACTION_ROW),
                read_json(spark, f"{data}/original", ORIGINAL_ROW),
                cand,
            ),
            f"{out}/sent",
        )


def sentiment_job(
    spark: SparkSession,
    data: str,
    lex: DataFrame,
    out: str,
    alpha: float = 15.0,
    form: str = "query",
    rules: sentiment.Rules | None = None,
) -> None:
    """Sentiment per author of original posts and per user referred to; ``rules`` as in ``sentiment_scores``."""
    with job_folder(spark):
        for name, schema, key in (
            ("original", ORIGINAL_ROW, "user_id_str"),
            ("connected", INTERACTION_ROW, "connected_user_single"),
        ):
            rows = read_json(spark, f"{data}/{name}", schema)
            scored = sentiment.sentiment_scores(rows, ["id_str", key], "text", lex, alpha, form, rules)
            write_csv(sentiment.sentiment_by(scored, key), f"{out}/{name}", header=True)
