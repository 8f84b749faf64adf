"""Telling rows apart that are equal in every column."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.sources.tables import stored


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many signs as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a first column ``name`` that differs for each row and is the same at every reading.

    Rows read from files go by file and place in it.  Others are stored once
    with a number.
    """
    if "_metadata" not in docs.columns:
        try:
            place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return docs.select(place.alias(name), *docs.columns)
        except AnalysisException:
            pass  # not read from files
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return stored(docs.select(number.alias(name), *docs.columns), "numbered")
