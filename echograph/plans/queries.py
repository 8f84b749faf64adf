"""Every operator as a query over the given tables.

Results are flat and comparable: days and arrays as strings, doubles rounded to
nine decimals.  Nothing here is part of the operators' own behaviour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.operators import engagement, graph, intake, profiles, ranking, sentiment
from echograph.plans import jobs
from echograph.schema import FLAT, HANDLE, INTERACTION_ROW, ORIGINAL_ROW, PAIR, PROFILE_COLUMNS
from echograph.sources import derived
from echograph.sources.posts import bad_lines, read_days, read_posts, split_days, write_days
from echograph.sources.tables import fresh_path, read_csv, read_json, stored, write_csv, write_json

#: Terms found in the given texts and event types; plain ASCII, so that every
#: regular expression engine folds their case alike.
TERMS = ["that", "purchase", "signup"]
TOPIC = ["purchase", "view"]

#: Valences for frequent words of the given English texts, which are invented.
LEXICON = [
    ("the", 1.5),
    ("of", -0.5),
    ("and", 0.8),
    ("to", -1.2),
    ("is", 0.4),
    ("that", -2.0),
    ("it", 1.0),
    ("for", -0.9),
]

#: Frequent words that the rules take for boosters and negations.
BOOSTERS = {"in": 0.293, "with": 0.293, "was": -0.293}
NEGATIONS = ["an", "this"]

CANDIDATES = 20
TOP = 50

Query = Callable[[SparkSession, str], DataFrame]


def _round(name: str) -> Column:
    return F.round(name, 9).alias(name)


def _day() -> Column:
    return F.date_format("day", "yyyy-MM-dd").alias("day")


def _flat(df: DataFrame, *extra: Column | str) -> DataFrame:
    columns = [
        F.concat_ws(",", "hashtags").alias("hashtags") if name == "hashtags" else F.col(name)
        for name in FLAT.names
    ]
    return df.select(*columns, *extra)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, valence double")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return graph.interaction_rows(derived.flat_posts(spark, sf, text=False))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stored(graph.interactions_per_pair(rows(spark, sf)), "pairs")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_weights(pairs(spark, sf))


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    return stored(graph.edge_weights(derived.trade(spark, sf), "count"), "trade")


def handles(spark: SparkSession, sf: str) -> DataFrame:
    return intake.handle_dictionary(derived.flat_posts(spark, sf, text=False))


def most_referred(spark: SparkSession, sf: str, k: int = CANDIDATES) -> DataFrame:
    """The candidate list of the profile queries."""
    received = graph.interactions_per_pair(rows(spark, sf)).groupBy(F.col("to_user").alias("users"))
    return profiles.candidates(received.agg(F.sum("n").alias("rank")), k)


# -- intake ---------------------------------------------------------------------


def q_read_posts(spark, sf):
    template = write_days(derived.posts(spark, sf, days_apart=False), fresh_path(spark, "posts"), by_day=True)
    return read_posts(spark, template.format("*")).select(
        "id_str", F.col("user.id_str").alias("user_id_str"), "created_at", "text"
    )


def q_archive_influencers(spark, sf):
    """Both jobs over the archive: day folders to files to ranked users."""
    template = write_days(derived.posts(spark, sf, days_apart=False), fresh_path(spark, "posts"), by_day=True)
    out = fresh_path(spark, "out")
    jobs.intake_job(spark, template, _all_days(spark, sf), TERMS, out)
    top = jobs.ranking_job(spark, out, out + "/ranked", TOP)
    return top.select("users", _round("rank"), "user_twitter_handle")


def _all_days(spark, sf) -> list[str]:
    """The different days of the events."""
    days = derived.own_posts(spark, sf).select(F.date_format("day", "yyyyMMdd").alias("day")).distinct()
    return [row[0] for row in days.orderBy("day").collect()]


def q_read_days(spark, sf):
    template = write_days(derived.posts(spark, sf, days_apart=False), fresh_path(spark, "posts"), by_day=True)
    # A day after the last one is asked for as well, and skipped.
    found = read_days(spark, template, _all_days(spark, sf) + ["29990101"])
    return found.groupBy(_day()).agg(F.count(F.lit(1)).alias("n_posts"))


def q_day_slice(spark, sf):
    """The three newest days but one."""
    template = write_days(derived.posts(spark, sf, days_apart=False), fresh_path(spark, "posts"), by_day=True)
    found = read_days(spark, template, _all_days(spark, sf), newest=3, skip=1)
    return found.groupBy(_day()).agg(F.count(F.lit(1)).alias("n_posts"))


def q_intake_report(spark, sf):
    """Stages, broken lines and absent days; every hundredth event adds a broken line to its day."""
    root = fresh_path(spark, "posts")
    write_days(derived.posts(spark, sf, days_apart=False), root + "/posts", by_day=True)
    broken = derived.own_posts(spark, sf).filter(F.col("id_str").cast("long") % 100 == 0)
    lines = broken.select(F.date_format("day", "yyyyMMdd").alias("day"), F.concat(F.lit('{"id_str": "'), "id_str").alias("line"))
    lines.write.partitionBy("day").option("compression", "gzip").text(root + "/broken")
    template = root + "/*/day={}/*.gz"
    found, skipped = split_days(spark, template, _all_days(spark, sf) + ["29990101"])
    counts = intake.intake_counts(read_days(spark, template, found), TERMS)
    return intake.intake_report(counts, bad_lines(spark, template, found), skipped).select(_day(), "stage", "n")


def q_posts_json_roundtrip(spark, sf):
    original, connected = graph.intermediate_rows(derived.flat_posts(spark, sf))
    path = fresh_path(spark, "rows")
    write_json(original, path + "/original")
    write_json(connected, path + "/connected")
    back = [
        read_json(spark, path + "/original", ORIGINAL_ROW),
        read_json(spark, path + "/connected", INTERACTION_ROW),
    ]
    return back[0].unionByName(back[1], allowMissingColumns=True).select(
        "id_str", "user_id_str", "text_hashtag", "connected_user_single"
    )


def q_flatten_posts(spark, sf):
    return _flat(intake.flatten_posts(*derived.keyed_posts(spark, sf)), _day())


def q_unnest_embedded(spark, sf):
    return _flat(intake.unnest_embedded(*derived.keyed_posts(spark, sf)), "origin", _day())


def q_keyword_filter(spark, sf):
    found = intake.keyword_filter(intake.unnest_embedded(*derived.keyed_posts(spark, sf)), TERMS)
    return found.select("id_str", "origin", "text_hashtag", _day())


def q_dedup_posts(spark, sf):
    return _flat(intake.dedup_posts(intake.unnest_embedded(*derived.keyed_posts(spark, sf))), _day())


def q_dedup_posts_by_id(spark, sf):
    return _flat(intake.dedup_posts(intake.unnest_embedded(*derived.keyed_posts(spark, sf)), "post_id"), _day())


def q_intake(spark, sf):
    raw, texts = derived.keyed_posts(spark, sf)
    return _flat(intake.intake(raw, TERMS, texts=texts), "text_hashtag", _day())


def q_intake_counts(spark, sf):
    raw, texts = derived.keyed_posts(spark, sf)
    return intake.intake_counts(raw, TERMS, texts=texts).select(_day(), "stage", "n")


def q_handle_dictionary(spark, sf):
    path = fresh_path(spark, "handles")
    write_csv(handles(spark, sf), path, header=True)
    return read_csv(spark, path, HANDLE, header=True)


# -- graph ----------------------------------------------------------------------


def q_connected_users(spark, sf):
    found = graph.connected_users(derived.flat_posts(spark, sf, text=False))
    return found.select(
        "id_str",
        "user_id_str",
        F.concat_ws(",", "connected").alias("connected"),
        F.size("connected").cast("long").alias("n_connected"),
    )


def q_interaction_rows(spark, sf):
    return rows(spark, sf).select("id_str", "user_id_str", "connected_user_single")


def q_original_posts(spark, sf):
    return graph.original_posts(derived.flat_posts(spark, sf, text=False)).select("id_str", "user_id_str")


def q_interactions_per_user(spark, sf):
    return graph.interactions_per_user(rows(spark, sf))


def q_interactions_per_pair(spark, sf):
    return graph.interactions_per_pair(rows(spark, sf))


def q_edge_weights(spark, sf):
    return edges(spark, sf).select("from_user", "to_user", _round("weight"))


def q_nation_edge_weights(spark, sf):
    weighted = graph.edge_weights(stored(derived.nation_trade(spark, sf), "pairs"))
    return weighted.select("from_user", "to_user", _round("weight"))


def q_topic_edges(spark, sf):
    return graph.topic_edges(graph.interaction_rows(derived.flat_posts(spark, sf)), TOPIC)


def q_graph_nodes(spark, sf):
    return graph.graph_nodes(edges(spark, sf))


def q_strongest_edges(spark, sf):
    return graph.strongest_edges(trade_edges(spark, sf), TOP)


def q_edges_csv_roundtrip(spark, sf):
    path = fresh_path(spark, "pairs")
    write_csv(graph.interactions_per_pair(rows(spark, sf)), path)
    return read_csv(spark, path, PAIR)


# -- ranking --------------------------------------------------------------------


def q_influence_rank(spark, sf):
    return ranking.influence_rank(edges(spark, sf)).select("users", _round("rank"))


def q_pagerank(spark, sf):
    return ranking.pagerank(stored(edges(spark, sf), "edges")).select("users", _round("rank"))


def _both(scores: tuple[DataFrame, DataFrame]) -> DataFrame:
    auth, hub = (
        df.select(F.lit(kind).alias("kind"), "node", _round("score"))
        for kind, df in zip(("auth", "hub"), scores)
    )
    return auth.unionByName(hub)


def _count_edges(spark, sf) -> DataFrame:
    return stored(graph.edge_weights(graph.interactions_per_pair(rows(spark, sf)), "count"), "edges")


def q_hits_l1(spark, sf):
    return _both(ranking.hits(_count_edges(spark, sf), rounds=5, norm="l1"))


def q_hits_l2(spark, sf):
    return _both(ranking.hits(trade_edges(spark, sf), rounds=10, norm="l2"))


def q_topic_hits(spark, sf):
    found = graph.topic_edges(graph.interaction_rows(derived.flat_posts(spark, sf)), TOPIC)
    return _both(ranking.hits(stored(found, "edges"), rounds=10, norm="l2"))


def q_top_influencers(spark, sf):
    top = ranking.top_influencers(ranking.influence_rank(edges(spark, sf)), handles(spark, sf), TOP)
    return top.select("users", _round("rank"), "user_twitter_handle")


def q_top_influencers_one_handle(spark, sf):
    top = ranking.top_influencers(
        ranking.influence_rank(edges(spark, sf)), handles(spark, sf), TOP, one_handle=True
    )
    return top.select("users", _round("rank"), "user_twitter_handle")


def _top_nodes(spark, sf, which: int) -> DataFrame:
    scores = ranking.hits(trade_edges(spark, sf), rounds=10, norm="l2")[which]
    top = ranking.top_nodes(scores, derived.handle_names(spark, sf))
    return top.select("node", _round("score"), "user_twitter_handle")


def q_top_authorities(spark, sf):
    return _top_nodes(spark, sf, 0)


def q_top_hubs(spark, sf):
    return _top_nodes(spark, sf, 1)


# -- candidates and profiles ------------------------------------------------------


def q_candidates(spark, sf):
    return profiles.candidates(ranking.influence_rank(edges(spark, sf)), TOP)


def q_candidate_count(spark, sf):
    posts, cand = derived.own_posts(spark, sf), most_referred(spark, sf)
    return profiles.candidate_count(profiles.daily_profile_panel(posts, cand))


def q_posts_per_user(spark, sf):
    return profiles.posts_per_user(derived.own_posts(spark, sf))


def q_latest_profile(spark, sf):
    return profiles.latest_profile(derived.own_posts(spark, sf)).withColumn(
        "create_rank", F.col("create_rank").cast("long")
    )


def q_latest_profile_by_time(spark, sf):
    return profiles.latest_profile(derived.own_posts(spark, sf), "time").withColumn(
        "create_rank", F.col("create_rank").cast("long")
    )


def q_user_history(spark, sf):
    return profiles.user_history(derived.own_posts(spark, sf))


def q_user_history_by_time(spark, sf):
    return profiles.user_history(derived.own_posts(spark, sf), order="time")


def q_user_history_one(spark, sf):
    """History of the user others refer to most."""
    user_id = most_referred(spark, sf, 1).first()["user_id_str"]
    return profiles.user_history(derived.own_posts(spark, sf), user_id)


def q_candidate_profiles(spark, sf):
    latest = profiles.latest_profile(derived.own_posts(spark, sf))
    return profiles.candidate_profiles(latest, most_referred(spark, sf)).select(*PROFILE_COLUMNS)


def q_missing_candidates(spark, sf):
    """Users someone refers to who are not found on the newest day."""
    posts = derived.own_posts(spark, sf)
    newest = posts.agg(F.max("day")).first()[0]
    found = profiles.latest_profile(posts.filter(F.col("day") == F.lit(newest)))
    cand = profiles.candidates(rows(spark, sf).select(F.col("connected_user_single").alias("users")))
    return profiles.missing_candidates(cand, found)


def q_backfill_profiles(spark, sf):
    found = profiles.backfill_profiles(derived.own_posts(spark, sf), most_referred(spark, sf))
    return found.select(_day(), *PROFILE_COLUMNS)


def q_backfill_profiles_none(spark, sf):
    """Of an empty candidate list: no rows, all columns."""
    found = profiles.backfill_profiles(derived.own_posts(spark, sf), profiles.no_candidates(spark))
    return found.select(_day(), *PROFILE_COLUMNS)


def q_daily_profile_panel(spark, sf):
    found = profiles.daily_profile_panel(derived.own_posts(spark, sf), most_referred(spark, sf))
    return found.select(_day(), *PROFILE_COLUMNS)


# -- engagement -------------------------------------------------------------------


def q_engagement_rate(spark, sf):
    rate = engagement.engagement_rate(derived.own_posts(spark, sf))
    return rate.select(*PROFILE_COLUMNS, "retweets_count", _round("ier"))


def q_backfill_engagement_rate(spark, sf):
    rate = engagement.backfill_engagement_rate(derived.own_posts(spark, sf), most_referred(spark, sf))
    return rate.select(_day(), *PROFILE_COLUMNS, "retweets_count", _round("ier"))


def q_engagement_rate_one(spark, sf):
    """Rate of the user others refer to most."""
    user_id = most_referred(spark, sf, 1).first()["user_id_str"]
    one = engagement.engagement_rate_one(derived.own_posts(spark, sf), user_id)
    return one.select("retweets", "favorites", "followers", _round("ier"))


def q_post_interactions(spark, sf):
    return engagement.post_interactions(derived.own_posts(spark, sf))


def q_counter_maxima(spark, sf):
    return engagement.counter_maxima(derived.own_posts(spark, sf))


def q_candidate_post_interactions(spark, sf):
    found = engagement.post_interactions(derived.own_posts(spark, sf))
    return engagement.candidate_post_interactions(found, most_referred(spark, sf))


def q_total_interactions(spark, sf):
    return engagement.total_interactions(derived.own_posts(spark, sf), most_referred(spark, sf))


def q_received_interactions(spark, sf):
    found = graph.interactions_per_pair(rows(spark, sf))
    return engagement.received_interactions(found, most_referred(spark, sf))


def q_sent_and_original(spark, sf):
    originals = graph.original_posts(derived.flat_posts(spark, sf, text=False))
    return engagement.sent_and_original(rows(spark, sf), originals, most_referred(spark, sf))


# -- sentiment --------------------------------------------------------------------


def q_sentiment_scores(spark, sf):
    return _turn_scores(spark, sf, "query")


def q_sentiment_scores_joined(spark, sf):
    return _turn_scores(spark, sf, "join")


def q_sentiment_scores_rules(spark, sf):
    return _turn_scores(spark, sf, "query", sentiment.Rules(BOOSTERS, NEGATIONS))


def _turn_scores(spark, sf, form: str, rules: sentiment.Rules | None = None) -> DataFrame:
    turns = derived.table(spark, sf, "conversations")
    scored = sentiment.sentiment_scores(turns, ["conv_id", "turn"], "text", lexicon(spark), form=form, rules=rules)
    return scored.select(
        "conv_id",
        "turn",
        *[_round(name) for name in sentiment.SCORES[:-1]],
        F.col("sentiment_compound_pos_ind").cast("long").alias("sentiment_compound_pos_ind"),
    )


def _by(scored: DataFrame, key: str) -> DataFrame:
    found = sentiment.sentiment_by(scored, key)
    average = [c for c in found.columns if c.startswith("avg_")][0]
    return found.select(*[_round(c) if c == average else F.col(c) for c in found.columns])


def q_sentiment_by_author(spark, sf):
    originals = graph.original_posts(derived.flat_posts(spark, sf))
    return _by(sentiment.sentiment_scores(originals, "user_id_str", "text", lexicon(spark)), "user_id_str")


def q_sentiment_by_target(spark, sf):
    # A post is scored once, however many it refers to.
    connected = graph.connected_posts(derived.flat_posts(spark, sf))
    scored = graph.interaction_rows(sentiment.with_scores(connected, "text", lexicon(spark)))
    return _by(scored, "connected_user_single")


QUERIES: dict[str, Query] = {
    name[2:]: query for name, query in list(globals().items()) if name.startswith("q_")
}
