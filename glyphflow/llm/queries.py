"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, class_lm, decontaminate, licenses, quality, sharding, simhash, suffixes, twins, url_rules
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark, sf_dir):
    """Rule statistics of each document, the base rules' verdict and the forest's."""
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "path_length")


def op2_license_scan(spark, sf_dir):
    """Places of the base phrases in each document, and labels and score by phrases and licence texts."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    starts = F.col("places.start")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), "base_labels", "labels", "score")


def op3_token_counts(spark, sf_dir):
    """Bytes and tokens of each document, and whether it has over 512 tokens."""
    return bpe.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])


def op4_sharding(spark, sf_dir):
    """Shard and slot of each document, under the law of even row counts."""
    found = sharding.assign(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontaminate(spark, sf_dir):
    """Hit words and occurring items of each document, and whether it is contaminated."""
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark), keep=["doc_id"])
    return decontaminate.report(found, ["doc_id"])


def op6_bpe_codec(spark, sf_dir):
    """Token count of each document, and digests of its ids and of what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_simhash_dedup(spark, sf_dir):
    """Fingerprint of each document and the smallest id of its class."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_class_lm(spark, sf_dir):
    """Unigram and class model scores of each document, from those that are not held out."""
    return class_lm.score(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_url_rules(spark, sf_dir):
    """Host, path, rule and verdict of each page's URL; pattern is the method's rule where that decided."""
    return url_rules.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op10_suffix_dedup(spark, sf_dir):
    """Removed bytes and runs of each document, and the digest of what stays."""
    return suffixes.removal_digests(table(spark, sf_dir, "documents"), Scratch(spark))


def queries():
    return {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_token_counts, op4_sharding, op5_decontaminate, op6_bpe_codec, op7_simhash_dedup, op8_class_lm, op9_url_rules, op10_suffix_dedup)}


def oracle_sql():
    return dict(twins.SQL)
