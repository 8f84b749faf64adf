"""Files between stages and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the session's ``spark.checkpoint.dir``.

    Only a local session may go without that setting and gets a folder of its
    own; a cluster must name one, since a machine-local folder dies with its
    machine.  Reliable checkpoints go to the same place.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="echograph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


#: Folder of the job that runs, if it has one.
_job: ContextVar[str | None] = ContextVar("job", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of the job that runs, else below the shared folder."""
    return f"{_job.get() or shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library made below the shared one."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside go to a folder of their own, which is removed at the end.

    For jobs that write their results elsewhere; what is read from the folder
    later is gone.
    """
    path = f"{shared_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    token = _job.set(path)
    try:
        yield path
    finally:
        _job.reset(token)
        removed(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For a table several later jobs read: they prune its columns, and a lost
    executor costs them no recomputation of what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, keys: list[str], buckets: int) -> Iterator[DataFrame]:
    """``df`` written once, in ``buckets`` parts by a hash of ``keys`` and sorted by them within each.

    Joins on ``keys`` find it partitioned and sorted, whatever round they are of, and a
    lost executor costs no more than reading its part again.  The table is in the
    session's catalog, under a name of its own, until the end.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    # Each part is one file, so its order may be relied on.
    order = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    known = spark.conf.get(order, None)
    spark.conf.set(order, "true")
    try:
        yield spark.table(name)
    finally:
        if known is None:
            spark.conf.unset(order)
        else:
            spark.conf.set(order, known)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, path)


class Rounds:
    """The tables of an iteration: each is written once, and only the last two are kept.

    A round's plan reads the table before it, so a lost executor costs one round.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.paths = spark, fresh_path(spark, name), []

    def keep(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """Write ``df`` and take ``metrics`` over it in the same action."""
        seen = Observation()
        observed = df.observe(seen, *[value.alias(name) for name, value in metrics.items()]) if metrics else df
        path = f"{self.base}/{len(self.paths)}"
        observed.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            removed(self.spark, self.paths[-3])
        return self.spark.read.schema(df.schema).parquet(path), seen.get if metrics else {}


def write_csv(df: DataFrame, path: str, header: bool = False, mode: str = "overwrite") -> None:
    """CSV directory; ``mode='errorifexists'`` refuses to replace one."""
    df.write.mode(mode).option("header", header).csv(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = False) -> DataFrame:
    """CSV with given names and types, so nothing is inferred."""
    return spark.read.schema(schema).option("header", header).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzip JSON lines; a file is as large as the task that writes it makes it."""
    df.write.mode(mode).option("compression", "gzip").json(path)


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines with a given schema; columns that are all null stay present."""
    return spark.read.schema(schema).json(path)
