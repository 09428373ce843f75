"""A corpus pipeline of five stages, each one of the operators of `lintlake.llm`.

Every stage works on all that the stage before it kept and is written as Parquet in the shared folder before
the next one reads it. All stages but the last give the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm.common import table, written
from lintlake.llm.near_duplicates import keep_one
from lintlake.llm.packing import digest, pack_documents
from lintlake.llm.quality import keep_good
from lintlake.llm.substrings import strip_repeats
from lintlake.llm.toxicity import keep_civil


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict keep."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a grammar fitted to the labels of the documents that came this far."""
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; `n_chars` is the new length."""
    return strip_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return digest(pack_documents(docs), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL has no tokenizer and no fitted grammar; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
