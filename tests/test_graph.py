from __future__ import annotations

import pytest
from conftest import embedded, flat, pairs, post, reply_to, table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echograph.functions.text import mentions
from echograph.operators import graph as G
from echograph.operators import skew
from echograph.operators.intake import keyword_filter


def _thrice(id_str="1", user="a", target="b", text=""):
    return post(
        id_str, user, text,
        **reply_to(target),
        quoted_status=embedded("q", target),
        retweeted_status=embedded("r", target),
    )


def test_one_post_can_refer_to_a_user_three_times(spark):
    df = flat(spark, _thrice(), post("2", "a"), post("3", "c", **reply_to("c")))
    assert table(G.connected_users(df), "id_str", "connected") == [("1", ["b", "b", "b"]), ("2", []), ("3", ["c"])]
    rows = G.interaction_rows(df)
    assert table(rows, "id_str", "connected_user_single") == [("1", "b")] * 3 + [("3", "c")]
    assert table(G.original_posts(df), "id_str") == [("2",)]
    assert table(G.interactions_per_user(rows)) == [("a", 3), ("c", 1)]
    assert table(G.interactions_per_pair(rows)) == [("a", "b", 3), ("c", "c", 1)]


def test_connected_users_are_quoted_replied_reshared(spark):
    df = flat(spark, post("1", "a", **reply_to("r"), quoted_status=embedded("5", "q"), retweeted_status=embedded("6", "s")))
    assert G.connected_users(df).first()["connected"] == ["q", "r", "s"]


def test_handles_and_tag_arrays_end_before_the_graph(spark):
    df = flat(spark, _thrice(), post("2", "a", "x", ["t", "u"]))
    assert not [c for c in G.interaction_rows(df).columns if "handle" in c or "screen_name" in c or c == "hashtags"]
    assert table(G.original_posts(df), "text_hashtag") == [("t,u",)]


def test_ratio_counts_self_references_but_drops_the_loop(spark):
    edges = G.edge_weights(pairs(spark, ("a", "a", 2), ("a", "b", 1), ("a", "c", 1), ("d", "d", 5)))
    assert table(edges) == [("a", "b", 0.25), ("a", "c", 0.25)]
    assert table(G.graph_nodes(edges)) == [("a",), ("b",), ("c",)]


def test_count_weights(spark):
    assert table(G.edge_weights(pairs(spark, ("a", "a", 2), ("a", "b", 3)), "count")) == [("a", "b", 3.0)]
    with pytest.raises(ValueError):
        G.edge_weights(pairs(spark, ("a", "b", 1)), "share")


def test_an_author_of_most_pairs_is_split(spark):
    rows = [("hub", f"t{i:04}", 1 + i % 3) for i in range(2000)] + [(f"u{i}", "hub", 2) for i in range(100)]
    df = pairs(spark, *rows)
    heavy = skew.heavy_keys(skew.row_counts(df, "from_user"), "from_user")
    average = df.count() / 8
    [(key, parts)] = [tuple(r) for r in heavy.collect()]
    assert key == "hub" and parts >= 8
    dealt = skew.split_rows(df, "from_user", "to_user", heavy)
    sizes = [r["count"] for r in dealt.filter("from_user = 'hub'").groupBy("part").count().collect()]
    assert len(sizes) == parts and sum(sizes) == 2000 and max(sizes) < average / 2
    total = sum(n for a, _, n in rows if a == "hub")
    expected = sorted((a, b, n / (total if a == "hub" else 2)) for a, b, n in rows)
    found = table(G.edge_weights(df))
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected])


def test_no_key_is_heavy_in_an_even_table(spark):
    df = pairs(spark, *[(f"a{i}", "b", 1) for i in range(100)])
    assert skew.heavy_keys(skew.row_counts(df, "from_user"), "from_user") is None
    assert skew.heavy_keys(skew.row_counts(df.filter("n > 5"), "from_user"), "from_user") is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), st.integers(1, 9), min_size=1))
def test_out_weights_sum_to_at_most_one(spark, table_):
    edges = G.edge_weights(pairs(spark, *[(a, b, n) for (a, b), n in table_.items()]))
    total = {}
    for a, b, w in table(edges):
        assert a != b and w > 0
        total[a] = total.get(a, 0) + w
    loops = {a for (a, b) in table_ if a == b}
    for a, w in total.items():
        assert w <= 1 + 1e-12
        if a not in loops:
            assert w == pytest.approx(1)


def test_topic_edges_count_equal_rows_once(spark):
    df = flat(
        spark,
        _thrice("1", text="GAME"),
        _thrice("1", text="GAME"),
        post("2", "a", "dull", ["game"], **reply_to("b")),
        post("3", "a", "dull", **reply_to("b")),
        post("4", "b", "game", **reply_to("b")),
        day=["2022-02-15", "2022-02-16", "2022-02-15", "2022-02-15", "2022-02-15"],
    )
    assert table(G.topic_edges(G.interaction_rows(df), ["game"])) == [("a", "b", 2.0)]


def test_strongest_edges_break_ties_by_id(spark):
    edges = G.edge_weights(pairs(spark, ("b", "c", 2), ("a", "c", 2), ("a", "b", 2), ("c", "a", 9)), "count")
    assert [tuple(r) for r in G.strongest_edges(edges, 3).collect()] == [
        ("c", "a", 9.0), ("a", "b", 2.0), ("a", "c", 2.0),
    ]


def test_connected_and_original_cover_all_posts(spark):
    df = flat(spark, _thrice(), post("2", "a"), post("3", "c", **reply_to("c")), post("4", "d", quoted_status=embedded("q", "x")))
    connected = {r[0] for r in table(G.interaction_rows(df), "id_str")}
    original = {r[0] for r in table(G.original_posts(df), "id_str")}
    assert connected | original == {"1", "2", "3", "4"} and not connected & original


def test_filtered_posts_keep_their_joined_tags(spark):
    df = keyword_filter(flat(spark, post("1", "a", "game", ["x"], **reply_to("b"))), ["game"])
    assert table(G.interaction_rows(df), "text_hashtag") == [("x",)]


def test_topic_edges_move_no_text(spark):
    rows = G.interaction_rows(flat(spark, post("1", "a", "x", **reply_to("b"))))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = G.topic_edges(rows, ["x"])._jdf.queryExecution().explainString(mode)
    # Its digest has the name; the scanned column does not get into an exchange.
    sent = [line for line in text.splitlines() if "Exchange" in line]
    assert sent and "sha2(cast(text#" in text


def test_hashtags_are_searched_before_texts(spark):
    condition = str(mentions(F.col("long"), F.col("short"), ["x"]))
    assert condition.index("short") < condition.index("long")
