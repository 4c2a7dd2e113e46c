"""A corpus pipeline over documents: quality rules, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows to the
shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphflow.llm import bpe, decontaminate, quality, simhash, suffixes
from glyphflow.llm.common import Scratch, dropping
from glyphflow.llm.queries import table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the isolation forest reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), Scratch(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one document of each group of linked fingerprints: that with the smallest id."""
    return simhash.keep_leaders(docs, Scratch(spark))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that stand anywhere else too; n_chars counts what stays."""
    return suffixes.drop_repeats(docs, Scratch(spark), length_col="n_chars")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return bpe.digests(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark passages", benchmark_passages), ("tokens", tokens)]

#: The forest, the fingerprints' classes and the tokens have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with dropping():  # what the stage wrote for itself
            done = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return docs
