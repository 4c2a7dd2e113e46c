"""Registered queries on requests and stores, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cache import encoded
from ..sources import files, requests
from .fixtures import view

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, CAST(n - 1 AS INT) AS image_idx, CASE WHEN conv_id % 2 = 0 THEN 'German' ELSE 'English' END AS target_language, md5(t) AS digest FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS c, text AS t FROM conversations) z WHERE c BETWEEN 1 AND 5")
def request_images(spark, sf):
    c = view(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    uris = F.transform("m", lambda x: F.concat(F.lit("data:image/png;base64,"), encoded(x["text"].cast("binary"))))
    body = F.to_json(F.struct(uris.alias("base64Images"), F.when(F.col("conv_id") % 2 == 0, "German").alias("targetLanguage")))
    rows = requests.image_rows(requests.parsed(c.select("conv_id", body.alias("body"))))
    return rows.select("conv_id", "image_idx", "target_language", F.md5("content").alias("digest"))


@query("SELECT doc_id, CASE WHEN text IS NOT NULL AND doc_id % 7 <> 0 THEN TRUE ELSE FALSE END AS success, CASE WHEN doc_id % 7 = 0 THEN 'Failed to decode image' END AS error FROM documents")
def frame_errors(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text").cast("binary")).alias("content"))
    return requests.frame_rows(d).select("doc_id", "success", "error")


@query("SELECT 'app-' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer")
def store_read_through(spark, sf):
    c = view(spark, sf, "customer").select(requests.prefixed(F.col("c_custkey").cast("string")).alias("key"), "c_custkey", "c_mktsegment", "c_name")
    return requests.read_through(c.where("c_custkey % 3 = 0").select("key", F.col("c_mktsegment").alias("value")), c.select("key", F.col("c_name").alias("value")), "key")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS segment, c_name AS name FROM customer")
def settings_upsert(spark, sf):
    t = view(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    changes = t.where("c_custkey % 4 = 0").select("c_custkey", F.lit("changed").alias("segment"), F.lit(None).cast("string").alias("name"))
    return requests.upsert(t, changes, "c_custkey")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id")
def body_chunks(spark, sf):
    c = view(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("body"))
    return files.chunks_joined(c, "conv_id", "turn", "body")


@query("SELECT 'd' || (doc_id % 5) AS folder, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY 1")
def folder_sizes(spark, sf):
    listing = view(spark, sf, "documents").select(F.concat(F.lit("file:/models/d"), F.col("doc_id") % 5, F.lit("/x/"), F.col("doc_id"), F.lit(".bin")).alias("path"), F.col("n_chars").alias("length"))
    return files.folder_sizes(listing, "file:/models")


@query("SELECT doc_id, 'data:' || CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END || ';base64,' || base64(encode(text)) AS uri FROM documents")
def upload_uri(spark, sf):
    return view(spark, sf, "documents").select("doc_id", files.data_uri(F.col("text").cast("binary"), F.when(F.col("doc_id") % 2 == 0, "image/png")).alias("uri"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'English' ELSE c_mktsegment END AS language, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name FROM customer")
def settings_reset(spark, sf):
    t = view(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("language"), F.col("c_name").alias("name"))
    return requests.reset(t, t.where("c_custkey % 4 = 0"), "c_custkey", {"language": "English"})


@query("SELECT conv_id, turn, role, turn % 3 <> 2 AS success, CASE WHEN turn % 3 <> 2 THEN md5('data:image/png;base64,' || base64(encode(text))) END AS digest, turn % 3 = 2 AS failed FROM conversations")
def fetched_images(spark, sf):
    """Addresses that hold their own bytes; every third is of a scheme that can't be opened."""
    uri = F.when(F.col("turn") % 3 != 2, F.concat(F.lit("data:image/png;base64,"), encoded(F.col("text").cast("binary")))).otherwise(F.concat(F.lit("none:"), "conv_id"))
    c = view(spark, sf, "conversations").select("conv_id", "turn", "role", uri.alias("uri"))
    return requests.fetched(c, "uri").select("conv_id", "turn", "role", "success", F.md5("content").alias("digest"), F.col("error").isNotNull().alias("failed"))
