"""A training-corpus pipeline: quality rules, exact and near deduplication, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes every stage's result to
shared storage and gives the next stage the reread table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelar.llm import bpe, exact_dedup, mixing, quality, simhash
from voxelar.plans.cut import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text is too short and goes; null ids and languages are values of their own;
    rows that repeat each keep their own verdict. All columns stay; an empty table stays empty.
    """
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the largest id.

    A null text counts as empty, so such rows equal each other; a null id is the smallest;
    of rows that repeat id and text one stays. All columns stay; an empty table stays empty.
    """
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the smallest id.

    Texts without words, null ones too, are never near copies; a null id is the smallest; of rows
    that repeat id and text one stays. All columns stay; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked source, language and topic weights."""
    return mixing.sample(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes of every document."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", tokens_stage),
]

#: The near-duplicate and token stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
