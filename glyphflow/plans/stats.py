"""Registered statistics queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .fixtures import view, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_T = with_views("stage_timings")
_LAT = """SELECT variant, count(*) AS iterations, avg(elapsed_ms) AS mean_ms, quantile_cont(elapsed_ms, 0.5) AS median_ms, stddev_pop(elapsed_ms) AS std_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms,
 quantile_cont(elapsed_ms, 0.95) AS p95_ms, quantile_cont(elapsed_ms, 0.99) AS p99_ms, stddev_pop(elapsed_ms) / avg(elapsed_ms) * 100 AS cv_percent, 1000 / avg(elapsed_ms) AS fps FROM stage_timings GROUP BY variant"""
_COLS = ("mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "p95_ms", "p99_ms", "cv_percent", "fps")


def _rounded(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query(f"{_T} SELECT variant, iterations, {_rounded(_COLS)} FROM ({_LAT}) z")
def latency_stats(spark, sf):
    s = S.latency(view(spark, sf, "stage_timings"), "variant", "elapsed_ms")
    return s.select("variant", "iterations", *[F.round(c, 6).alias(c) for c in _COLS])


@query(f"{_T} SELECT variant, round(avg(elapsed_ms), 6) AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms FROM stage_timings GROUP BY variant")
def translation_stats(spark, sf):
    return view(spark, sf, "stage_timings").groupBy("variant").agg(F.round(F.avg("elapsed_ms"), 6).alias("avg_ms"), F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms"))


@query(f"{_T}, w AS (SELECT event_id % 6 AS instance, max(elapsed_ms) AS warm_ms FROM stage_timings GROUP BY 1) SELECT count(*) AS instances, round(avg(warm_ms), 6) AS avg_ms, max(warm_ms) AS max_ms, max(warm_ms) AS total_ms FROM w")
def pool_warmup(spark, sf):
    w = view(spark, sf, "stage_timings").groupBy((F.col("event_id") % 6).alias("instance")).agg(F.max("elapsed_ms").alias("warm_ms"))
    return w.agg(F.count("*").alias("instances"), F.round(F.avg("warm_ms"), 6).alias("avg_ms"), F.max("warm_ms").alias("max_ms"), F.max("warm_ms").alias("total_ms"))


@query(f"{_T}, s AS ({_LAT}) SELECT variant, round(fps, 6) AS fps, round((SELECT mean_ms FROM s WHERE variant = 'click') / mean_ms, 6) AS speedup FROM s")
def speedup(spark, sf):
    s = S.against_baseline(S.latency(view(spark, sf, "stage_timings"), "variant", "elapsed_ms"), "variant", "click", "mean_ms")
    return s.select("variant", F.round("fps", 6).alias("fps"), F.round("speedup", 6).alias("speedup"))


@query(f"{_T}, s AS ({_LAT}) SELECT variant, round(fps, 6) AS fps FROM s ORDER BY s.fps DESC, variant LIMIT 1")
def best_performer(spark, sf):
    b = S.best(S.latency(view(spark, sf, "stage_timings"), "variant", "elapsed_ms"), "variant", "fps")
    return b.select("variant", F.round("fps", 6).alias("fps"))


_Y = with_views("yolo_labels")
_COUNTS = "SELECT split, class_id, count(*) AS instances FROM yolo_labels GROUP BY split, class_id"


@query(f"{_Y} {_COUNTS}")
def class_counts(spark, sf):
    return S.class_counts(view(spark, sf, "yolo_labels"))


_ADVICE = "concat_ws(',', CASE WHEN instances < 10000 THEN 'low instances' END, CASE WHEN instances < 5000 THEN 'very low instances' END, CASE WHEN images < 1000 THEN 'low images' END)"


@query(f"""{_Y}, t AS (SELECT coalesce(split, 'all') AS split, count(*) AS instances, count(DISTINCT image_id) AS images FROM yolo_labels GROUP BY ROLLUP (split))
 SELECT split, instances, images, CASE WHEN images > 0 THEN round(CAST(instances AS DOUBLE) / images, 6) END AS per_image, {_ADVICE} AS advice, CASE WHEN instances >= 10000 THEN 'good' WHEN instances >= 5000 THEN 'usable' ELSE 'small' END AS status,
 CASE WHEN instances < 5000 THEN CAST(0.9 AS DOUBLE) WHEN instances < 10000 THEN 0.8 ELSE 0.5 END AS mosaic, CASE WHEN instances < 5000 THEN CAST(0.15 AS DOUBLE) WHEN instances < 10000 THEN 0.1 ELSE 0.0 END AS mixup, CAST(CASE WHEN instances < 5000 THEN 100 WHEN instances < 10000 THEN 50 ELSE 30 END AS INT) AS epochs FROM t""")
def dataset_summary(spark, sf):
    # two levels, so that an image's rows meet before splits are added up: no distinct set is kept for a whole split
    images = view(spark, sf, "yolo_labels").groupBy("split", "image_id").agg(F.count("*").alias("n"))
    t = images.rollup("split").agg(F.sum("n").alias("instances"), F.count("*").alias("images"))
    n, m = F.col("instances"), F.col("images")
    return t.select(F.coalesce("split", F.lit("all")).alias("split"), "instances", "images", F.when(m > 0, F.round(n / m, 6)).alias("per_image"), F.concat_ws(",", S.advice(n, m)).alias("advice"), S.status(n).alias("status"), *S.settings(n))


@query(f"{_Y}, c AS ({_COUNTS}), m AS (SELECT class_id, CAST(sum(instances) AS BIGINT) AS n FROM c GROUP BY class_id) SELECT count(*) AS classes, max(n) AS largest, min(n) AS smallest, count(*) > 1 AND max(n) > 5 * min(n) AS imbalanced FROM m")
def class_imbalance(spark, sf):
    return S.imbalanced(S.class_counts(view(spark, sf, "yolo_labels")))


@query("SELECT event_id, CASE WHEN m >= 0.8 THEN 'excellent' WHEN m >= 0.6 THEN 'good' WHEN m >= 0.4 THEN 'fair' ELSE 'poor' END AS tier, CASE WHEN p > r + CAST(0.2 AS DOUBLE) THEN 'conservative' WHEN r > p + CAST(0.2 AS DOUBLE) THEN 'aggressive' ELSE 'balanced' END AS leaning FROM (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS m, CAST(event_id % 97 AS DOUBLE) / 96 AS p, CAST(user_id % 89 AS DOUBLE) / 88 AS r FROM events) z")
def quality_tier(spark, sf):
    e = view(spark, sf, "events")
    p, r = (F.col("event_id") % 97).cast("double") / 96, (F.col("user_id") % 89).cast("double") / 88
    return e.select("event_id", S.quality_tier((F.col("event_id") % 101).cast("double") / 100).alias("tier"), S.leaning(p, r).alias("leaning"))


@query("SELECT user_id, CASE WHEN b > 0 THEN round(a / b, 6) ELSE CAST(0 AS DOUBLE) END AS ratio FROM (SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS a, coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) AS b FROM events GROUP BY user_id) z")
def batch_ratio(spark, sf):
    of = lambda k: F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0))
    s = view(spark, sf, "events").groupBy("user_id").agg(of("click").alias("a"), of("view").alias("b"))
    return s.select("user_id", F.round(S.safe_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))
