from __future__ import annotations

import gzip
import json
from datetime import date
from pathlib import Path

import pytest
from conftest import post, reply_to, table
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echograph.schema import ORIGINAL_ROW, PAIR
from echograph.sources import posts as P
from echograph.sources import tables


def _day(root: Path, day: str, lines: list[str], name: str = "part.json.gz") -> None:
    folder = root / day
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt") as out:
        out.write("\n".join(lines) + "\n")


def test_reads_gzip_days_and_skips_missing_ones(spark, tmp_path):
    _day(tmp_path, "20220214", [json.dumps(post("1", "a", "x"))])
    _day(tmp_path, "20220216", [json.dumps(post("2", "b", "y")), json.dumps(post("3", "b", "z"))])
    template = str(tmp_path) + "/{}/*.json.gz"
    found = P.read_days(spark, template, ["20220214", "20220215", "20220216"])
    assert table(found, "day", "id_str") == [
        (date(2022, 2, 14), "1"),
        (date(2022, 2, 16), "2"),
        (date(2022, 2, 16), "3"),
    ]
    present, skipped = P.split_days(spark, template, ["20220214", "20220215", "20220216"])
    assert list(present) == ["20220214", "20220216"] and skipped == ["20220215"]


def test_a_day_column_alone_can_be_counted(spark, tmp_path):
    _day(tmp_path, "20220214", [json.dumps(post("1", "a")), "{broken"])
    counted = P.read_days(spark, str(tmp_path) + "/{}/*.json.gz", ["20220214"]).groupBy("day").count()
    assert table(counted) == [(date(2022, 2, 14), 1)]


def test_no_day_present_gives_an_empty_typed_table(spark, tmp_path):
    found = P.read_days(spark, str(tmp_path) + "/{}/*.json.gz", ["20220214"])
    assert found.count() == 0
    assert found.columns[-1] == "day" and "retweeted_status" in found.columns


def test_broken_lines_are_left_out_and_counted(spark, tmp_path):
    _day(tmp_path, "20220214", [json.dumps(post("1", "a", "x")), '{"id_str": "2", "text": "cut'])
    _day(tmp_path, "20220215", [json.dumps(post("3", "a", "x"))])
    template = str(tmp_path) + "/{}/*.json.gz"
    days = ["20220214", "20220215"]
    assert table(P.read_days(spark, template, days), "id_str") == [("1",), ("3",)]
    assert table(P.bad_lines(spark, template, days)) == [(date(2022, 2, 14), 1)]


def test_a_field_of_a_wrong_type_is_null(spark, tmp_path):
    record = post("1", "a", "x")
    record["quote_count"] = "many"
    _day(tmp_path, "20220214", [json.dumps(record)])
    found = P.read_posts(spark, str(tmp_path) + "/20220214/*.json.gz")
    assert table(found, "id_str", "quote_count") == [("1", None)]


def test_odd_escapes_are_read(spark, tmp_path):
    _day(tmp_path, "20220214", [r'{"created_at":"c","id_str":"1","text":"it\'s"}'])
    assert table(P.read_posts(spark, str(tmp_path) + "/*/*.json.gz"), "text") == [("it's",)]


def test_a_corrupt_file_does_not_stop_the_read(spark, tmp_path):
    _day(tmp_path, "20220214", [json.dumps(post("1", "a", "x"))])
    (tmp_path / "20220214" / "bad.json.gz").write_bytes(b"\x1f\x8b\x08\x00garbage")
    path = str(tmp_path) + "/20220214/*.json.gz"
    with pytest.raises(Exception, match="FAILED_READ_FILE|gzip|Exception"):
        P.read_posts(spark, path).collect()
    assert table(P.read_posts(spark, path, skip_corrupt=True), "id_str") == [("1",)]


def test_a_cut_file_fails_unless_its_rest_may_go(spark, tmp_path):
    _day(tmp_path, "20220214", [json.dumps(post(str(i), "a", f"text {i * 7919}")) for i in range(3000)])
    file = tmp_path / "20220214" / "part.json.gz"
    file.write_bytes(file.read_bytes()[: file.stat().st_size // 3])
    template = str(tmp_path) + "/{}/*.json.gz"
    with pytest.raises(Exception, match="FAILED_READ_FILE|EOF|Exception"):
        P.read_days(spark, template, ["20220214"]).collect()
    assert 0 < P.read_days(spark, template, ["20220214"], skip_corrupt=True).count() < 3000


def test_a_readable_post_without_a_date_is_kept(spark, tmp_path):
    _day(tmp_path, "20220214", ['{"id_str": "1", "text": "x", "quote_count": "many"}', "{broken"])
    template = str(tmp_path) + "/{}/*.json.gz"
    assert table(P.read_days(spark, template, ["20220214"]), "id_str", "quote_count") == [("1", None)]
    assert table(P.bad_lines(spark, template, ["20220214"])) == [(date(2022, 2, 14), 1)]


def test_day_slices_are_newest_first(spark, tmp_path):
    days = ["20220213", "20220214", "20220216", "20220217"]
    for day in days:
        _day(tmp_path, day, [json.dumps(post(day, "a"))])
    template = str(tmp_path) + "/{}/*.json.gz"
    asked = [*days, "20220215"]
    slices = {(2, 0): days[:1:-1], (2, 1): ["20220216", "20220214"], (None, 3): ["20220213"], (9, 9): []}
    for (newest, skip), want in slices.items():
        assert table(P.read_days(spark, template, asked, newest=newest, skip=skip), "id_str") == [(d,) for d in sorted(want)]
    found, skipped = P.split_days(spark, template, asked)
    assert skipped == ["20220215"] and P.read_days(spark, template, found).count() == 4
    assert P.split_days(spark, template, []) == ({}, [])


def test_day_without_quotes_needs_no_inference(spark, tmp_path):
    _day(tmp_path, "20220214", ['{"created_at":"c","id_str":"1","text":"x"}'])
    found = P.read_posts(spark, str(tmp_path) + "/20220214/*.json.gz")
    assert table(found, "quoted_status.user.id_str") == [(None,)]


def test_written_days_come_back(spark, path):
    from conftest import raw

    posts = raw(
        spark,
        post("1", "a", "ü \\ \" x", ["t"], **reply_to("b")),
        post("2", "b", None),
        day=["2022-02-14", "2022-02-15"],
    )
    template = P.write_days(posts, path("days"))
    back = P.read_days(spark, template, ["20220214", "20220215"])
    columns = ["id_str", "text", "in_reply_to_user_id_str", "user", "entities", "day"]
    assert table(back, *columns) == table(posts, *columns)


def test_csv_modes_and_header(spark, path):
    df = spark.createDataFrame([("S1", "b", 2)], PAIR)
    tables.write_csv(df, path("pairs"), mode="errorifexists")
    with pytest.raises(AnalysisException):
        tables.write_csv(df, path("pairs"), mode="errorifexists")
    tables.write_csv(df, path("pairs"), header=True)
    assert table(tables.read_csv(spark, path("pairs"), PAIR, header=True)) == [("S1", "b", 2)]


def test_json_keeps_columns_that_are_all_null(spark, path):
    row = {name: None for name in ORIGINAL_ROW.names} | {"id_str": "1"}
    tables.write_json(spark.createDataFrame([row], ORIGINAL_ROW), path("rows"))
    back = tables.read_json(spark, path("rows"), ORIGINAL_ROW)
    assert back.columns == ORIGINAL_ROW.names
    assert table(back, "id_str", "quoted_time") == [("1", None)]


def test_shared_folder_is_the_one_the_session_names(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_dir(spark) == base
    assert tables.fresh_path(spark, "x").startswith(base)
    kept = tables.stored(spark.range(3).toDF("n"), "numbers")
    assert table(kept) == [(0,), (1,), (2,)]
    assert all(f.startswith("file:") and base in f for f in kept.inputFiles())


def test_a_job_leaves_nothing_in_the_shared_folder(spark):
    base = Path(tables.shared_dir(spark))
    before = set(base.iterdir())
    with tables.job_folder(spark) as folder:
        assert table(tables.stored(spark.range(3).toDF("n"), "numbers")) == [(0,), (1,), (2,)]
        assert Path(folder).exists()
    assert set(base.iterdir()) == before and not Path(folder).exists()
    with pytest.raises(ValueError):
        tables.removed(spark, str(base.parent))


def test_rounds_keep_the_last_two_tables(spark):
    rounds = tables.Rounds(spark, "steps")
    for i in range(5):
        df, seen = rounds.keep(spark.range(i + 1).toDF("n"), total=F.sum("n"), rows=F.count("n"))
        assert seen == {"total": sum(range(i + 1)), "rows": i + 1} and df.count() == i + 1
    assert sorted(p.name for p in Path(rounds.base).iterdir()) == ["3", "4"]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())


def test_schema_can_be_narrowed(spark, tmp_path):
    _day(tmp_path, "20220214", [json.dumps(post("1", "a", "x"))])
    narrow = T.StructType([T.StructField("id_str", T.StringType())])
    found = P.read_posts(spark, str(tmp_path) + "/20220214/*.json.gz", narrow)
    assert found.columns == ["id_str"] and table(found) == [("1",)]


def test_files_that_lose_their_rest_are_found(spark, tmp_path):
    for day in ("20220214", "20220215", "20220216"):
        _day(tmp_path, day, [json.dumps(post(str(i), "a", f"text {i * 7919}")) for i in range(3000)])
    cut = tmp_path / "20220215" / "part.json.gz"
    (tmp_path / "20220215" / "a {b} [c].json.gz").write_bytes(cut.read_bytes())
    (tmp_path / "20220216" / "bad.json.gz").write_bytes(b"\x1f\x8b\x08\x00garbage")
    cut.write_bytes(cut.read_bytes()[: cut.stat().st_size // 3])
    template = str(tmp_path) + "/{}/*.json.gz"
    lost = P.lost_files(spark, template, ["20220214", "20220215", "20220216", "20220217"]).collect()
    assert sorted((str(r["day"]), r["path"].rsplit("/", 1)[1], r["bytes"]) for r in lost) == [
        ("2022-02-15", "part.json.gz", cut.stat().st_size), ("2022-02-16", "bad.json.gz", 11),
    ]
    lines = {r["path"].rsplit("/", 1)[1]: r["lines"] for r in lost}
    assert 0 < lines["part.json.gz"] < 3000 and lines["bad.json.gz"] == 0
    assert P.lost_files(spark, template, ["20220214"]).collect() == [] and P.lost_files(spark, template, ["20220301"]).collect() == []


def test_json_rows_are_compressed(spark, path):
    tables.write_json(spark.createDataFrame([("S1", "b", 2)], PAIR), path("rows"))
    assert {p.suffix for p in Path(path("rows")).glob("part-*")} == {".gz"}
    assert table(tables.read_json(spark, path("rows"), PAIR)) == [("S1", "b", 2)]
