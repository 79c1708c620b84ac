"""From raw documents to packed training sequences: each stage is one operator of ``riskweave.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import bk_simhash, containment, histogram_packing, language_pieces, line_templates
from riskweave.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no learned language reaches a posterior of one half."""
    return language_pieces.identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of recurring templates out of all but the first document that has them; rows stay."""
    return line_templates.deduplicated(docs, long_from=line_templates.LONG_LINE, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints."""
    return bk_simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return containment.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece."""
    return histogram_packing.pack(docs).drop("row_hash")


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination), ("best_fit_packing", packing),
]

#: Tokens, fingerprints and learned languages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
