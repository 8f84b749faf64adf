"""Plans hold what makes them scale."""

from __future__ import annotations

import re
from contextlib import ExitStack

import pytest
from conftest import SF_DIR, pairs, weights

import __spark_entry__ as contract
from echograph.operators import engagement as E
from echograph.operators import graph as G
from echograph.operators import profiles as P
from echograph.operators import ranking as R
from echograph.operators import sentiment as S
from echograph.plans.queries import lexicon
from echograph.sources import derived
from echograph.sources.tables import stored


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LAZY = [
    "flatten_posts", "unnest_embedded", "intake", "intake_counts", "interactions_per_pair", "latest_profile",
    "user_history", "backfill_profiles", "daily_profile_panel", "engagement_rate", "total_interactions",
    "received_interactions", "sent_and_original", "sentiment_by_author", "edge_weights", "top_influencers",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, name, no_broadcast):
    text = plan(contract.queries()[name](spark, SF_DIR))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition"):
        assert banned not in text


ONE_TEXT = ["dedup_posts_by_id", "dedup_posts", "unnest_embedded", "flatten_posts", "intake_counts", "keyword_filter", "intake"]


@pytest.mark.parametrize("name", ONE_TEXT)
def test_a_text_moves_by_itself(spark, name, no_broadcast):
    """Texts go to the rows that have them; no post or row is moved with a text, and no text once for each day."""
    text = plan(contract.queries()[name](spark, SF_DIR))
    moved = [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]
    texts = [columns for columns in moved if columns & {"text", "first", "found"}]
    assert texts and all(columns <= {"text_key", "_groupingexpression", "text", "lang", "first", "valueSet", "_text_digest", "_text_part"} for columns in texts)


def test_latest_rows_are_picked_before_the_shuffle(spark):
    posts = derived.own_posts(spark, SF_DIR)
    cand = spark.createDataFrame([("1",)], "user_id_str string")
    for df in (P.latest_profile(posts), P.daily_profile_panel(posts, cand), P.backfill_profiles(posts, cand)):
        assert "WindowGroupLimit" in plan(df)


def test_scans_read_only_what_is_needed(spark):
    text = plan(G.interactions_per_pair(G.interaction_rows(derived.flat_posts(spark, SF_DIR, text=False))))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    assert "documents" not in text and "props" not in text
    assert text.count("partial_count") == 1


def test_sentiment_needs_no_shuffle(spark):
    df = S.sentiment_scores(derived.table(spark, SF_DIR, "documents"), "doc_id", "text", lexicon(spark))
    assert "Exchange" not in plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(df)


@pytest.mark.parametrize("hot", [False, True])
def test_rounds_shuffle_partial_sums_only(spark, no_broadcast, hot):
    """Two half-rounds on kept edges: no shuffle or sort of the edges, and nothing cached."""
    rows = {(f"u{0 if hot and i % 2 else i}", f"v{i if hot else i % 400}", 1.0) for i in range(4000)}
    edges = stored(weights(spark, *sorted(rows)), "edges")
    with ExitStack() as kept:
        by_from, heavy_from = R._kept_by(edges, "from_user", "to_user", kept)
        by_to, heavy_to = R._kept_by(edges, "to_user", "from_user", kept)
        assert (heavy_from is not None) == hot and heavy_to is None
        auth = R._summed(by_from.selectExpr("to_user AS node", "weight AS score"))
        hub = R._summed(R._pass_on(by_to, auth, "to_user", "from_user", heavy_to))
        auth = R._summed(R._pass_on(by_from, hub, "from_user", "to_user", heavy_from))
        text = auth._jdf.queryExecution().sparkPlan().toString()
        executed = auth._jdf.queryExecution().executedPlan().toString()
        # One exchange per sum, and with parts of hot nodes one of the copied scores.
        assert executed.count("ENSURE_REQUIREMENTS") == 3 + hot and "REPARTITION" not in executed and "InMemoryTableScan" not in executed
        assert text.count("SortMergeJoin") == 2
        # Only scores are sorted: every sort stands above an aggregate or a copied score, never above a scan of edges.
        lines = executed.splitlines()
        for k, line in enumerate(lines):
            if " Sort [" in line:
                below = next(x for x in lines[k + 1 :] if "Project" not in x and "Filter" not in x)
                assert "FileScan" not in below
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_pairs_are_read_from_the_stored_table(spark):
    kept = stored(pairs(spark, ("a", "b", 1), ("b", "a", 2)), "pairs")
    text = plan(G.edge_weights(kept))
    assert "LocalTableScan" not in text and text.count("Scan parquet") >= 2


@pytest.mark.parametrize("name", ["panel", "backfill", "interactions", "totals"])
def test_a_hot_candidate_is_dealt_over_tasks(spark, no_broadcast, name):
    """One author of a third of all posts, and a list too large to broadcast."""
    ids = spark.range(30_000).selectExpr("id", "CAST(IF(id % 3 = 0, 0, id) AS STRING) AS author")
    posts = ids.selectExpr(
        "CAST(id AS STRING) AS id_str", "concat('Tue Feb 15 01:02:', id) AS created_at", "date '2022-02-15' AS day",
        "named_struct('id_str', author, 'screen_name', author, 'verified', false, 'followers_count', 1L, 'friends_count', 1L, "
        "'favourites_count', 1L, 'statuses_count', 1L, 'created_at', '') AS user",
        "1L AS quote_count", "1L AS reply_count", "1L AS retweet_count", "1L AS favorite_count",
    )
    cand = ids.select(ids["author"].alias("user_id_str")).distinct()
    rows = {
        "panel": lambda: P.candidate_profiles(P.profiles(posts), cand),
        "backfill": lambda: P.candidate_profiles(P.profiles(posts), cand),
        "interactions": lambda: E.candidate_post_interactions(E.post_interactions(posts), cand),
        "totals": lambda: E.of_users(posts, cand),
    }[name]()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [n for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 30_000 and max(sizes) < 10_000
    if name == "panel":
        assert "WindowGroupLimit" in plan(P.daily_profile_panel(posts, cand))


def test_equal_rows_of_one_candidate_are_dealt_too(spark, no_broadcast):
    """A third of all rows equal in every column."""
    ids = spark.range(30_000).selectExpr("CAST(IF(id % 3 = 0, 0, id) AS STRING) AS author").repartition(8)
    posts = ids.selectExpr("named_struct('id_str', author) AS user", "'Tue Feb 15 01:02:03 +0000 2022' AS created_at")
    cand = ids.select(ids["author"].alias("user_id_str")).distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = E.of_users(posts, cand).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 30_000 and max(sizes) < 8_000


def test_weights_read_the_pairs_twice(spark):
    kept = stored(pairs(spark, ("a", "b", 1), ("b", "a", 2)), "pairs")
    G.edge_weights(kept)  # the aggregate per author is stored on the way
    assert plan(G.edge_weights(kept)).count("Scan parquet") <= 4  # two scans, each named twice
