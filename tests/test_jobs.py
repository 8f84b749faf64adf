"""Whole jobs over hand-written day folders, file to file."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

import pytest
from conftest import embedded, post, reply_to, table

from echograph.operators import sentiment
from echograph.plans import jobs
from echograph.schema import HANDLE, INTERACTION_ROW, ORIGINAL_ROW, PAIR, USER_COUNT
from echograph.sources.tables import read_csv, read_json, shared_dir

DAYS = ["20220214", "20220215", "20220216"]


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    star = embedded("s1", "star", "game is good", ["fun"])
    days = {
        "20220214": [
            post("1", "a", "game!", **reply_to("star", "s0")),
            post("2", "b", "dull", retweeted_status=star),
            post("3", "b", "unrelated"),
        ],
        "20220216": [
            post("1", "a", "game!", **reply_to("star", "s0")),
            post("4", "star", "my GAME is bad", retweet_count=3, created_at="Wed Feb 16 01:00:00 +0000 2022"),
            post("5", "a", "game", quoted_status=embedded("6", "b", "game b"), **reply_to("a")),
        ],
    }
    for day, posts in days.items():
        (root / day).mkdir()
        with gzip.open(root / day / "p.json.gz", "wt") as out:
            out.write("\n".join(json.dumps(p) for p in posts) + "\n{broken\n")
    return str(root) + "/{}/*.json.gz"


@pytest.fixture(scope="module")
def data(spark, archive, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("data"))
    assert jobs.intake_job(spark, archive, DAYS, ["game"], out) == ["20220215"]
    return out


def test_intake_files(spark, data):
    # "2" is dull itself; what it reshares is kept as a row of its own.
    assert table(spark.read.parquet(f"{data}/posts"), "id_str") == [("1",), ("1",), ("4",), ("5",), ("6",), ("s1",)]
    assert table(read_csv(spark, f"{data}/pairs", PAIR)) == [("a", "a", 1), ("a", "b", 1), ("a", "star", 2)]
    assert table(read_csv(spark, f"{data}/users", USER_COUNT)) == [("a", 4)]
    assert table(read_csv(spark, f"{data}/handles", HANDLE, header=True)) == [("a", "@a"), ("star", "@star")]
    assert table(read_json(spark, f"{data}/original", ORIGINAL_ROW), "id_str") == [("4",), ("6",), ("s1",)]
    connected = read_json(spark, f"{data}/connected", INTERACTION_ROW)
    assert table(connected, "id_str", "connected_user_single") == [("1", "star"), ("1", "star"), ("5", "a"), ("5", "b")]


def test_ranking_files(spark, data, path):
    top = jobs.ranking_job(spark, data, path("ranked"), k=2)
    assert [r["users"] for r in top.orderBy("rank", ascending=False).collect()] == ["star", "b"]
    lines = [line for f in Path(path("ranked")).glob("*.csv") for line in f.read_text().splitlines()]
    assert len(lines) == 2 and all(line.count(",") == 2 for line in lines)
    assert sum(float(line.split(",")[1]) for line in lines) <= 1
    neighbours = jobs.ranking_job(spark, data, path("pagerank"), k=1, rounds=2, neighbours=True)
    assert neighbours.first()["users"] == "star"


@pytest.mark.parametrize("terms", [None, ["game"]])
def test_hits_files(spark, data, path, terms):
    jobs.hits_job(spark, data, path("hits"), terms, rounds=2)
    schema = "node string, score double, handle string"
    authorities = spark.read.schema(schema).csv(path("hits") + "/authorities").collect()
    hubs = spark.read.schema(schema).csv(path("hits") + "/hubs").collect()
    assert [r["node"] for r in authorities] == ["star"] and authorities[0]["score"] > 0.7
    assert [(r["node"], r["score"], r["handle"]) for r in hubs] == [("a", 1.0, "@a")]


def test_profile_files(spark, archive, data, path):
    jobs.ranking_job(spark, data, path("ranked"), k=3)
    jobs.profile_job(spark, archive, DAYS, data, path("ranked"), path("out"))

    def read(name, schema):
        return table(spark.read.schema(schema).csv(f"{path('out')}/{name}"))

    panel = read("panel", "day string, user string, handle string")
    # Two posts of one second tie, so both rows stay.
    assert [r[:2] for r in panel] == [
        ("2022-02-14", "a"), ("2022-02-14", "b"), ("2022-02-14", "b"),
        ("2022-02-16", "a"), ("2022-02-16", "a"), ("2022-02-16", "star"),
    ]
    assert read("missing", "user string") == []
    assert read("total_interactions", "user string, n long") == [("star", 3)]
    assert read("received", "user string, n long") == [("a", 1), ("b", 1), ("star", 2)]
    assert read("sent", "user string, cnt long, ori_cnt long") == []


def test_sentiment_files(spark, data, path):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "token string, valence double")
    jobs.sentiment_job(spark, data, lex, path("out"))
    authors = spark.read.csv(path("out") + "/original", header=True)
    assert table(authors.select(authors.columns[0], "num_original_tweets", "num_pos_tweets")) == [
        ("b", "1", "1"), ("star", "2", "1"),
    ]
    targets = spark.read.csv(path("out") + "/connected", header=True)
    assert table(targets.select(targets.columns[0], "num_original_tweets_interacting")) == [
        ("a", "1"), ("b", "1"), ("star", "2"),
    ]


def test_the_report_names_what_is_missing(spark, data):
    report = table(spark.read.csv(f"{data}/report").selectExpr("_c0", "_c1", "_c2"))
    found = {(day, stage): int(n) for day, stage, n in report}
    assert found["2022-02-14", "read"] == 3 and found["2022-02-16", "read"] == 3
    assert found["2022-02-14", "broken"] == found["2022-02-16", "broken"] == found["2022-02-15", "skipped"] == 1
    assert not any(day == "2022-02-15" and stage != "skipped" for day, stage in found)


def test_jobs_leave_no_tables_behind(spark, data, path):
    base = Path(shared_dir(spark))
    before = set(base.iterdir())
    jobs.ranking_job(spark, data, path("ranked"), k=2)
    jobs.ranking_job(spark, data, path("pagerank"), k=1, rounds=3, neighbours=True)
    jobs.hits_job(spark, data, path("hits"), rounds=2)
    lex = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    jobs.sentiment_job(spark, data, lex, path("scores"), form="join")
    assert set(base.iterdir()) == before


def test_the_report_counts_files_that_lost_their_rest(spark, archive, tmp_path):
    root = Path(archive.replace("/{}/*.json.gz", ""))
    for day in ("20220214", "20220216"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "p.json.gz").write_bytes((root / day / "p.json.gz").read_bytes())
    whole = (tmp_path / "20220216" / "p.json.gz").read_bytes()
    (tmp_path / "20220216" / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="FAILED_READ_FILE|EOF|Exception"):
        jobs.intake_job(spark, str(tmp_path) + "/{}/*.json.gz", DAYS, ["game"], out)
    jobs.intake_job(spark, str(tmp_path) + "/{}/*.json.gz", DAYS, ["game"], out, skip_corrupt=True)
    report = {(r[0], r[1]): int(r[2]) for r in spark.read.csv(f"{out}/report").collect()}
    assert report["2022-02-16", "lost_files"] == 1 and ("2022-02-14", "lost_files") not in report
    (lost,) = spark.read.csv(f"{out}/lost", header=True).collect()
    assert lost["path"].endswith("20220216/cut.json.gz") and int(lost["bytes"]) == len(whole) // 2


def test_sentiment_job_with_rules_and_hits_job_with_accents(spark, data, path):
    lex = spark.createDataFrame([("bad", -2.0)], "token string, valence double")
    jobs.sentiment_job(spark, data, lex, path("plain"))
    jobs.sentiment_job(spark, data, lex, path("rules"), rules=sentiment.Rules(boosters={"is": 0.5}))
    scores = [
        {r[0]: float(r["avg_sentiment_compound"]) for r in spark.read.csv(path(name) + "/original", header=True).collect()}
        for name in ("plain", "rules")
    ]
    assert scores[0]["b"] == scores[1]["b"] == 0 and scores[1]["star"] < scores[0]["star"] < 0
    jobs.hits_job(spark, data, path("hits"), ["GAME"], rounds=1, unicode_case=True)
    assert spark.read.csv(path("hits") + "/authorities").first()[0] == "star"


def test_posts_of_a_job_are_written_where_they_are(spark, tmp_path):
    rows = spark.range(300).selectExpr("CAST(id AS STRING) AS id_str", "date_add(date '2022-02-14', CAST(id % 2 AS INT)) AS day").repartition(3)
    back = jobs._by_day(rows, str(tmp_path / "posts"))
    assert table(back, "id_str", "day") == table(rows, "id_str", "day")
    files = {day.name: [f.name for f in day.glob("*.parquet")] for day in (tmp_path / "posts").glob("day=*")}
    assert {day: len(names) for day, names in files.items()} == {"day=2022-02-14": 3, "day=2022-02-15": 3}
    assert all(".zstd." in name for names in files.values() for name in names)
