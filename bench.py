"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1); BENCH_CPUS: local
threads (default 8); BENCH_RUNS: timed runs per query after one warm-up
(default 3, the median counts); BENCH_QUERIES: comma-separated subset.
Intake runs on posts stored beforehand, so that the operator is what is timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from echograph.operators import intake  # noqa: E402
from echograph.plans.queries import QUERIES, TERMS  # noqa: E402
from echograph.sources import derived  # noqa: E402
from echograph.sources.tables import stored  # noqa: E402

#: Operators timed on nested posts that were stored before.
ON_STORED_POSTS = {"intake": intake.intake, "intake_counts": intake.intake_counts}

HEADLINE = [
    "intake",
    "intake_counts",
    "interactions_per_pair",
    "edge_weights",
    "influence_rank",
    "pagerank",
    "hits_l1",
    "hits_l2",
    "top_influencers",
    "latest_profile",
    "backfill_profiles",
    "engagement_rate",
    "total_interactions",
    "sentiment_by_author",
    "sentiment_by_target",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("echograph-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Rounds of an iteration differ in stage ids only; share their compiled code.
        .config("spark.sql.codegen.useIdInClassName", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="echograph-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    posts = stored(derived.posts(spark, sf_dir), "posts") if ON_STORED_POSTS.keys() & set(names) else None

    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            on_posts = ON_STORED_POSTS.get(name)
            df = on_posts(posts, TERMS) if on_posts else QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
