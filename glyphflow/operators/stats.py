"""Latency statistics, comparisons with a baseline, and dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Tiers of a dataset by its instances and images, and of a model by its mAP at 0.5.
LOW, VERY_LOW, FEW_IMAGES, IMBALANCE = 10000, 5000, 1000, 5


#: Places of the sorted values that percentiles are read at, and how closely the first pass finds them (rows per place).
PLACES, ACCURACY = (0.5, 0.95, 0.99), 10_000


def percentiles(rows: DataFrame, key: str, value: str, places: tuple[float, ...] = PLACES, accuracy: int = ACCURACY) -> DataFrame:
    """key and p: the interpolated percentiles of each key's values, exact; null for keys without values.

    A first pass finds, by a sketch, between which values each place must lie; a second counts the values below and keeps
    the few between as (value, count), so that no task holds a key's values.
    """
    rows = rows.select(key, F.col(value).cast("double").alias("v"))
    ends = [min(max(p + d * 2 / accuracy, 0.0), 1.0) for p in places for d in (-1, 1)]
    found = rows.groupBy(key).agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, ends)), accuracy).alias("e"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    few = F.col("n") <= accuracy
    spans = [F.struct(F.lit(i).alias("i"), F.when(few, F.col("lo")).otherwise(F.col("e")[2 * i]).alias("lo"), F.when(few, F.col("hi")).otherwise(F.col("e")[2 * i + 1]).alias("hi")) for i in range(len(places))]
    found = found.select(F.col(key).alias("_k"), "n", F.array(*spans).alias("spans"))
    met = rows.where("v is not null").join(found.select("_k", "spans"), F.col(key).eqNullSafe(F.col("_k"))).select("_k", "v", F.explode("spans").alias("s")).where("v <= s.hi")
    kept = met.groupBy("_k", F.col("s.i").alias("i"), F.when(F.col("v") >= F.col("s.lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = kept.withColumn("upto", F.sum("c").over(W.partitionBy("_k", "i").orderBy(F.asc_nulls_first("v"))))
    at = F.get(F.array(*map(F.lit, places)), F.col("i")) * (F.col("n") - 1)
    placed = upto.join(found.select(F.col("_k").alias("_n"), "n"), F.col("_k").eqNullSafe(F.col("_n"))).withColumn("at", at)
    low = F.min(F.when(F.col("upto") > F.floor("at"), F.col("v")))
    top = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v")))
    each = placed.groupBy("_k", "i").agg(low.alias("low"), top.alias("top"), F.first(F.col("at") - F.floor("at")).alias("part"))
    each = each.select("_k", "i", F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("top") - F.col("low")) * F.col("part")).alias("p"))
    lists = each.groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("p"))
    return found.select(F.col("_k").alias(key)).join(lists, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "p")


def latency(rows: DataFrame, key: str, ms: str) -> DataFrame:
    """Mean, median, population deviation, extremes, interpolated percentiles, variation in percent and frames a second."""
    p = percentiles(rows, key, ms).select(F.col(key).alias("_p"), "p")
    s = rows.groupBy(key).agg(F.count("*").alias("iterations"), F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms")).join(p, F.col(key).eqNullSafe(F.col("_p")), "left")
    return s.select(key, "iterations", F.col("mean").alias("mean_ms"), F.col("p")[0].alias("median_ms"), F.col("std").alias("std_ms"), "min_ms", "max_ms", F.col("p")[1].alias("p95_ms"), F.col("p")[2].alias("p99_ms"), (F.col("std") / F.col("mean") * 100).alias("cv_percent"), (F.lit(1000.0) / F.col("mean")).alias("fps"))


def against_baseline(stats: DataFrame, key: str, baseline: str, value: str) -> DataFrame:
    """speedup: the baseline's value over each row's; null without a baseline. The baseline is one row, joined as a scalar."""
    base = stats.where(F.col(key) == baseline).agg(F.max(value).alias("_base"))
    return stats.crossJoin(F.broadcast(base)).withColumn("speedup", F.col("_base") / F.col(value)).drop("_base")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def best(stats: DataFrame, key: str, value: str) -> DataFrame:
    """The row with the largest value; of equal ones the first by key."""
    return stats.agg(F.min_by(key, F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias(key), F.max(value).alias(value))


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("split", "class_id").agg(F.count("*").alias("instances"))


def imbalanced(counts: DataFrame) -> DataFrame:
    """Over all splits: classes, extremes, and whether the largest has over five times the smallest."""
    merged = counts.groupBy("class_id").agg(F.sum("instances").alias("n"))
    return merged.agg(F.count("*").alias("classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"), ((F.count("*") > 1) & (F.max("n") > IMBALANCE * F.min("n"))).alias("imbalanced"))


def advice(total: Column, images: Column) -> Column:
    """Warnings as a list, in order."""
    found = F.array(F.when(total < LOW, "low instances"), F.when(total < VERY_LOW, "very low instances"), F.when(images < FEW_IMAGES, "low images"))
    return F.filter(found, lambda x: x.isNotNull())


def status(total: Column) -> Column:
    return F.when(total >= LOW, "good").when(total >= VERY_LOW, "usable").otherwise("small")


def settings(total: Column) -> list[Column]:
    """Suggested augmentation and epochs."""
    pick = lambda a, b, c: F.when(total < VERY_LOW, a).when(total < LOW, b).otherwise(c)
    return [pick(0.9, 0.8, 0.5).alias("mosaic"), pick(0.15, 0.1, 0.0).alias("mixup"), pick(100, 50, 30).alias("epochs")]


def quality_tier(map50: Column) -> Column:
    return F.when(map50 >= 0.8, "excellent").when(map50 >= 0.6, "good").when(map50 >= 0.4, "fair").otherwise("poor")


def leaning(precision: Column, recall: Column) -> Column:
    return F.when(precision > recall + 0.2, "conservative").when(recall > precision + 0.2, "aggressive").otherwise("balanced")
