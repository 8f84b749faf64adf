"""What Python workers need: this package from where the driver has it, and memory given back.

On a cluster whose machines do not share that folder, ship it (``--py-files``)
or install it; this changes nothing then.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

#: Workers live on between tasks.  With these, large arrays that a task has freed go
#: back to the system instead of staying with the worker.
MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
}

#: Texts differ in size without bound, so batches for workers are closed by bytes.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def importable(spark: SparkSession) -> None:
    """Puts the package's folder on the path of the session's Python workers, and sets their memory use."""
    environment = spark.sparkContext.environment
    for name, value in MEMORY.items():
        environment.setdefault(name, value)
    spark.conf.set(BATCH[0], str(BATCH[1]))
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, ROOT])


def on_workers(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query``, whose first argument is the session, with the package importable on its workers."""

    @wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        importable(spark)
        return query(spark, *rest)

    return run
