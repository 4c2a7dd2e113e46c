"""Registered queries that call models (fixed stubs), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from .fixtures import view

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, CAST(i AS INT) AS box_idx, CAST(10 * i AS INT) AS min_x, CAST(5 * i AS INT) AS min_y, CAST(10 * i + 40 + length(text) % 7 AS INT) AS max_x, CAST(5 * i + 30 AS INT) AS max_y FROM (SELECT doc_id, text, unnest(range(CAST(length(text) % 4 AS BIGINT))) AS i FROM documents) z")
def detect_udtf(spark, sf):
    b = view(spark, sf, "documents").select("doc_id", M.detect(F.col("text")).alias("bs"))
    return b.select("doc_id", F.posexplode("bs").alias("box_idx", "b")).select("doc_id", "box_idx", "b.*")


@query("SELECT doc_id, text || '.' AS ocr_text FROM documents")
def ocr_udf(spark, sf):
    return view(spark, sf, "documents").select("doc_id", M.ocr(F.col("text"))["value"].alias("ocr_text"))


@query("SELECT conv_id, turn, role, CASE WHEN trim(t) = '' THEN '' ELSE '[en] ' || reverse(t) END AS translated FROM (SELECT conv_id, turn, role, text AS t FROM conversations) z")
def translate_udf(spark, sf):
    c = view(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("t"), F.lit("en").alias("lang"))
    return M.translate_distinct(c, "t", "lang").select("conv_id", "turn", "role", "translated")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '[0-9]') THEN '' ELSE upper(t) END AS value, CASE WHEN regexp_matches(t, '[0-9]') THEN 'digit' END AS error FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'id ' || doc_id ELSE lang || source[1:3] END AS t FROM documents) z")
def error_isolation(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("id "), F.col("doc_id"))).otherwise(F.concat("lang", F.left("source", F.lit(3)))).alias("t"))
    r = d.select("doc_id", M.ocr(F.col("t"), "strict").alias("r"))
    return r.select("doc_id", "r.value", "r.error")


@query(SQL["ocr_udf"])
def provider_fallback(spark, sf):
    """The first provider doesn't load, the second does."""
    return view(spark, sf, "documents").select("doc_id", M.ocr(F.col("text"), "fallback")["value"].alias("ocr_text"))


@query(SQL["ocr_udf"])
def sequential_map(spark, sf):
    return view(spark, sf, "documents").select("doc_id", M.ocr(F.col("text"), "ordered")["value"].alias("ocr_text"))


@query("SELECT conv_id, turn, role, text || '.' AS value, '[' || l || '] .' || reverse(text) AS translated FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'de' ELSE 'fr' END AS l FROM conversations) z")
def read_and_translate(spark, sf):
    """Both models in one pass: no shuffle between them."""
    lang = F.when(F.col("turn") % 2 == 0, "de").otherwise("fr")
    return view(spark, sf, "conversations").select("conv_id", "turn", "role", M.read_and_translate(F.col("text"), lang).alias("r")).select("conv_id", "turn", "role", "r.value", "r.translated")
