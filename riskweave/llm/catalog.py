"""The operators as queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    bk_simhash, chat_tree, containment, cross_alignment, histogram_packing, html_crf, int8_join, language_pieces, line_templates,
    permuterm, pii_tagger, token_counts, toxic_lexicon,
)
from riskweave.llm.common import table


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(table(spark, sf_dir, "pages"))


def op2_int8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int8_join.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_pieces.predictions(table(spark, sf_dir, "documents"))


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat_tree.read_back(chat_tree.trees(rows), ordered=True)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.deduplicated(documents, long_from=line_templates.LONG_LINE).select("doc_id", "n_lines", "n_dropped", "text")


def op6_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.personal_data(table(spark, sf_dir, "documents"))


def op7_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_shared", "n_shingles", "containment")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk_simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.variants(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_lexicon.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment.aligned(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_html_crf, op2_int8_neighbours, op3_language_id, op4_chat_trees, op5_line_templates, op6_pii_tagger,
        op7_histogram_packing, op8_benchmark_containment, op9_simhash_groups, op10_token_counts, op11_spelling_variants,
        op12_toxicity, op13_cross_alignment)}
