"""A corpus pipeline: rejects poor documents, keeps one of each near-duplicate class, drops benchmark leaks, encodes."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from concord.llm import bpe, decontamination, ngram_join, quality
from concord.llm.queries import WORD_BPE
from concord.llm.shared import cut, remove, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are scored as texts without words."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that n-gram similarity links; of a null doc_id only where its class has no other, and all without words."""
    return ngram_join.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null doc_ids and texts stay, and all rows of a doc_id go together."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), short_loss=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of the whole text, a row for each row; null and empty texts have none."""
    return bpe.with_tokens(docs, public_tokenizers.path(WORD_BPE)).select("doc_id", "token_ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]
#: A learned classifier and MinHash classes are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
