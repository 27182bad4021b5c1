"""A corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import decontamination, packing, queries, shared, simhash, substring_dedup, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of strings that the pipeline removes where they repeat: fewer than fifty words have, so that passages of that length go.
PASSAGE_BYTES = 256


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels of ``docs``, finds toxic go.

    A null text is empty and stays, as does a null id; repeated rows share a fate, and columns of any name are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the least by its id.

    Null and empty texts are one group; a repeated row stays once; columns of any name are kept.
    """
    return simhash.without_near_duplicates(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their strings of ``PASSAGE_BYTES`` that start elsewhere too; the documents stay.

    A null text comes out empty. A repeated row is a copy, so that its text goes if it is that long. Columns of any name are kept.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that names don't clash
    kept = substring_dedup.without_repeats(docs.select("text", row), PASSAGE_BYTES, with_text=True)
    changed = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("text").cast("long"))
    return kept.select(changed.alias("row")).select("row.*")


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts, repeated rows and columns of any name stay."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of token sequences. A null text is empty: its end token; repeated rows are packed each."""
    return packing.packed(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("SimHash near-dedup", remove_near_duplicates),
    ("suffix-array dedup", remove_repeated_strings),
    ("benchmark decontamination", remove_contaminated),
    ("packing", pack),
]

#: No SQL: the stages' operators are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{k}")
    return docs
