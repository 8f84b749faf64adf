"""From raw documents to token files in five stages, each written as Parquet and read again.

Every stage works on all that the one before kept.  All but the last return the
columns of ``documents``; cleaning and decontamination change texts, the mix
repeats documents that it takes twice.  Rows that are equal in every column are
documents of their own throughout.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from echograph.llm import cleaning, decontamination, jaccard, mixing, tokens
from echograph.llm.shipping import on_workers
from echograph.sources.tables import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@on_workers
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much or fail the base rules."""
    return cleaning.cleaned(docs)


@on_workers
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id, empty texts all."""
    return jaccard.one_of_each(docs)


@on_workers
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@on_workers
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


@on_workers
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids in the token files."""
    return tokens.read_back(tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
    ("token output", token_output),
]

#: The mix and the tokenizer are beyond SQL; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
