"""The training-data pipeline: stages over the documents table, each written and read again.

All stages but the last return the columns of ``documents``; the last adds each
text's token ids. Every stage decides on all rows its predecessor kept.

Null and empty texts, repeated rows, null ids, extra columns and empty tables are
taken as the operators say: see ``langid.keep_identified``,
``lines.without_repeats``, ``simhash.keep_one``, ``decontaminate.without_leaks``
and ``bpe.encode_checked``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import batches, bpe, decontaminate, langid, lines, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language's centroids go; a null ``lang`` is filled in."""
    return langid.keep_identified(batches.session(spark), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near lines one occurrence stays; no document goes."""
    return lines.without_repeats(batches.session(spark), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(batches.session(spark), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.without_leaks(batches.session(spark), docs, batches.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    batches.session(spark)
    return bpe.encode_checked(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can't express most stages; a test holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = batches.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = batches.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
