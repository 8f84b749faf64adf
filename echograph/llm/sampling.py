"""Bounded samples of lines for training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_lines(docs: DataFrame, id_column: str, n_docs: int, n_lines: int, seed: int) -> list[str]:
    """At most ``n_lines`` distinct lines with words of documents with ``n_docs`` ids, both chosen by hash.

    Documents without an id or a text give none.
    """
    ids = docs.select(F.col(id_column).alias("id")).filter("id is not null").distinct()
    chosen = [r["id"] for r in ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n_docs).collect()]
    lines = docs.filter(F.col(id_column).isin(chosen)).select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).distinct()
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(n_lines).collect()]
