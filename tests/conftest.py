from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from echograph.schema import POST  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("echograph-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.useIdInClassName", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def path(tmp_path):
    return lambda name: str(tmp_path / name)


def author(user_id: str, handle: str | None = None) -> dict:
    return {"id_str": user_id, "screen_name": handle or f"@{user_id}"}


def post(id_str: str, user_id: str, text: str | None = "", tags: list[str] | None = None, **more) -> dict:
    """A raw post as a JSON-like dict; ``more`` sets or adds fields."""
    user = {
        **author(user_id),
        "verified": False,
        "followers_count": 10,
        "friends_count": 1,
        "favourites_count": 5,
        "statuses_count": 7,
        "created_at": "Fri Jan 01 00:00:00 +0000 2021",
        **more.pop("user", {}),
    }
    record = {
        "created_at": "Tue Feb 15 01:02:03 +0000 2022",
        "id_str": id_str,
        "text": text,
        "user": user,
        "quote_count": 0,
        "reply_count": 0,
        "retweet_count": 0,
        "favorite_count": 0,
        **more,
    }
    if tags is not None:
        record["entities"] = {"hashtags": [{"text": t} for t in tags]}
    return record


def reply_to(user_id: str, post_id: str = "r") -> dict:
    return {
        "in_reply_to_status_id_str": post_id,
        "in_reply_to_user_id_str": user_id,
        "in_reply_to_screen_name": f"@{user_id}",
    }


def embedded(id_str: str, user_id: str, text: str = "", tags: list[str] | None = None, **more) -> dict:
    record = {
        "created_at": "Mon Feb 14 01:02:03 +0000 2022",
        "id_str": id_str,
        "text": text,
        "user": author(user_id),
        **more,
    }
    if tags is not None:
        record["entities"] = {"hashtags": [{"text": t} for t in tags]}
    return record


def raw(spark, *posts: dict, day: str | list[str] = "2022-02-15"):
    """Nested posts with ``day``."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    days = [day] * len(posts) if isinstance(day, str) else day
    schema = T.StructType(POST.fields + [T.StructField("day", T.StringType())])
    rows = [{**p, "day": d} for p, d in zip(posts, days)]
    return spark.createDataFrame(rows, schema).withColumn("day", F.to_date("day"))


def flat(spark, *posts: dict, **more):
    from echograph.operators.intake import flatten_posts

    return flatten_posts(raw(spark, *posts, **more))


def table(df, *columns: str) -> list[tuple]:
    """Sorted plain tuples, nulls last."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def pairs(spark, *rows: tuple[str, str, int]):
    return spark.createDataFrame(list(rows), "from_user string, to_user string, n long")


def weights(spark, *rows: tuple[str, str, float]):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "from_user string, to_user string, weight double")
