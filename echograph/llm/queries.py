"""The dealt operators as queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from echograph.llm import chat, cleaning, collocations, decontamination, filteraudit, fixity, jaccard, maintext, mixing, privacy, scoring, secretscan, tokens
from echograph.llm.rows import with_row
from echograph.llm.shipping import on_workers

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes."""
    sized = mixing.sized_documents(with_row(_table(spark, sf_dir, "documents"), "place"), row="place")
    return mixing.mix_sizes(sized).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op2_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.judged(_table(spark, sf_dir, "documents"))


def op3_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of a second replica of the pages' archive, whose decay follows from the page ids."""
    layout, replica = fixity.two_replicas(_table(spark, sf_dir, "pages"))
    return fixity.audited(layout, replica).select("page_id", "status", "length", "expected", "found")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_table(spark, sf_dir, "documents"))


def op5_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token files."""
    import public_tokenizers

    files = tokens.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_back(files)


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.rendered(_table(spark, sf_dir, "conversations"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.personal_data(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's score and verdict."""
    return secretscan.scored(_table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_texts(_table(spark, sf_dir, "pages"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    query.__name__: on_workers(query)
    for query in (
        op1_mix_sources,
        op2_line_cleaning,
        op3_fixity_audit,
        op4_language_model,
        op5_fm_decontamination,
        op6_token_files,
        op7_snapshot_collapse,
        op8_personal_data,
        op9_jaccard_join,
        op10_secret_scan,
        op11_main_text,
        op12_filter_interactions,
        op13_phrase_collocations,
        pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op2_line_cleaning": cleaning.ORACLE,
    "op3_fixity_audit": fixity.ORACLE,
    "op5_fm_decontamination": decontamination.ORACLE,
    "op7_snapshot_collapse": chat.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op11_main_text": maintext.ORACLE,
    "op12_filter_interactions": filteraudit.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
}
