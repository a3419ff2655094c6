"""The pN_ queries: each applies one operator to its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import encode_corpus
from tessera.llm.consensus import consensus_letters, rater_reliability
from tessera.llm.contamination import leaked_fields, leaked_pairs
from tessera.llm.frequency import marked_values, term_frequency
from tessera.llm.names import entities, same_entity
from tessera.llm.pivot import same_incident, theme_clusters
from tessera.llm.spam import stuffed_pages, stuffed_shares
from tessera.llm.twopoisson import characteristic_terms, term_distinctiveness
from tessera.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entity(table(spark, sf_dir, "gazetteer"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(table(spark, sf_dir, "gazetteer"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characteristic_terms(term_distinctiveness(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "multipipeline_per_cluster")))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_distinctiveness(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "multipipeline_per_cluster"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_values(term_frequency(table(spark, sf_dir, "corpus")))


def p3_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequency(table(spark, sf_dir, "corpus"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_incident(table(spark, sf_dir, "corpus"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theme_clusters(table(spark, sf_dir, "corpus"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_consensus(spark, sf_dir).select("study_id", "cluster_id", "letter")


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_letters(table(spark, sf_dir, "survey_responses"))


def p5_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rater_reliability(table(spark, sf_dir, "survey_responses"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), VOCABULARY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_fields(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), {"passage": 14, "question": 8})  # questions have 8 to 12 words


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_shares(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
