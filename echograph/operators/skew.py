"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys are cut into parts of this share of an average partition.  Parts fall
#: on partitions by hash, so smaller ones even out better; each costs one copy of
#: the other side's row.
PARTS_PER_PARTITION = 16

#: Parts in which rows meet a candidate list.
CANDIDATE_PARTS = 32


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions: joins with shuffled tables find the same layout."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_counts(df: DataFrame, key: str) -> DataFrame:
    """``key, rows`` of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def heavy_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """Keys with more rows than an average partition, as ``key, parts``.

    ``parts`` says into how many pieces the key is cut.  Fewer keys than there
    are partitions can qualify, so the list is safe to bring to the driver
    and to broadcast.  None when no key qualifies, the usual case.  ``counts``
    holds ``key, rows`` and is read twice: pass a stored table.
    """
    rows = counts.agg(F.sum("rows")).first()[0] or 0
    average = max(rows / partitions(counts), 1.0)
    parts = F.ceil(F.col("rows") * F.lit(PARTS_PER_PARTITION) / F.lit(average)).cast("int")
    heavy = counts.filter(F.col("rows") > F.lit(average)).select(key, parts.alias("parts")).collect()
    if not heavy:
        return None
    return counts.sparkSession.createDataFrame(heavy, counts.select(key, F.lit(1).alias("parts")).schema)


def split_keys(key: str, heavy: DataFrame | None) -> list[str]:
    """Join keys of split rows: the key alone when no key is heavy."""
    return [key] if heavy is None else [key, "part"]


def split_rows(df: DataFrame, key: str, by: str, heavy: DataFrame | None) -> DataFrame:
    """Add ``part``: heavy keys are dealt over their parts by a hash of ``by``."""
    if heavy is None:
        return df
    parts = F.coalesce(F.col("parts"), F.lit(1))
    return (
        df.join(F.broadcast(heavy), key, "left")
        .withColumn("part", F.pmod(F.hash(F.col(by)), parts))
        .drop("parts")
    )


def repeat_rows(df: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """Add ``part``: one copy of a heavy key's row for each of its parts."""
    if heavy is None:
        return df
    last = F.coalesce(F.col("parts"), F.lit(1)) - 1
    return (
        df.join(F.broadcast(heavy), key, "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), last)))
        .drop("parts")
    )


def balanced_join(
    many: DataFrame, one: DataFrame, key: str, by: str, heavy: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Join ``many`` rows per key with at most ``one`` row per key.

    Without heavy keys this is a plain equi-join, left to Spark.  With them, a
    heavy key's rows are spread over the tasks in parts well below an average
    partition.
    """
    left, right = split_rows(many, key, by, heavy), repeat_rows(one, key, heavy)
    return left.join(right, split_keys(key, heavy), how).drop("part")


def of_candidates(rows: DataFrame, cand: DataFrame, key: str = "user_id_str") -> DataFrame:
    """Rows whose ``key`` is in the candidate list.

    A small list is broadcast.  A large one is shuffled in as many copies as
    there are parts, and rows are dealt over the parts one after the other, so a user of
    a third of all rows is dealt evenly even if all those rows are equal; what groups the
    rows afterwards shuffles them anew, with its own map-side step.
    """
    part = F.pmod(F.monotonically_increasing_id(), F.lit(CANDIDATE_PARTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(CANDIDATE_PARTS - 1)))
    wanted = cand.select(F.col(key), copies.alias("candidate_part"))
    return rows.withColumn("candidate_part", part).join(wanted, [key, "candidate_part"], "left_semi").drop("candidate_part")
