"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paddock.llm import (
    conversations,
    decontamination,
    licences,
    lm_scoring,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def substring_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(documents).drop("text_id")


def licence_query(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def lm_query(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.scores(_table(spark, folder, "documents"))


def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write(_table(spark, folder, "pages"), warc.new_folder(spark))
    return warc.read(archives, with_payload=False).drop("url")


def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def decontamination_query(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def token_count_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_ids(_table(spark, folder, "documents"))


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return toxicity.scores(documents, toxicity.learn(documents, _table(spark, folder, "labels")))


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def conversation_query(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_audits(_table(spark, folder, "conversations"))


def periodic_run_query(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.planted(_table(spark, folder, "documents")))


def quality_classifier_query(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return quality_classifier.scores(documents, quality_classifier.learn(documents, _table(spark, folder, "labels")))


QUERIES: dict[str, Query] = {
    "op1_suffix_array_dedup": substring_dedup_query,
    "op2_license_scan": licence_query,
    "op3_lm_scoring": lm_query,
    "op4_warc": warc_query,
    "op5_packing": packing_query,
    "op6_decontamination": decontamination_query,
    "op7_token_counts": token_count_query,
    "op8_simhash": simhash_query,
    "op9_toxicity": toxicity_query,
    "op10_quality_rules": quality_query,
    "op11_conversation_repair": conversation_query,
    "op12_periodic_runs": periodic_run_query,
    "op13_quality_classifier": quality_classifier_query,
}

#: What SQL can express; the other operators are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licences.oracle_sql(),
    "op6_decontamination": decontamination.oracle_sql(),
}
