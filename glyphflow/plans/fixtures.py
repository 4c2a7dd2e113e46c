"""Derived views over the driver's tables, in SQL that Spark and DuckDB both run (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "boxes": """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS box_idx,
  CAST(x0 AS INT) AS min_x, CAST(y0 AS INT) AS min_y, CAST(x0 + w AS INT) AS max_x, CAST(y0 + h AS INT) AS max_y, confidence
  FROM (SELECT l_orderkey AS page_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
    (l_partkey * 7919 + l_linenumber * 131) % 900 AS x0, (l_suppkey * 104729 + l_partkey * 31) % 1200 AS y0,
    40 + (l_partkey * 13) % 260 AS w, 30 + (CAST(l_quantity AS INT) * 17) % 300 AS h,
    CAST((l_partkey * 37 + l_suppkey * 11 + CAST(l_quantity AS INT) * 101) % 1000 AS DOUBLE) / 1000 AS confidence FROM {lineitem}) z""",
    "raw_detections": """SELECT page_id, box_idx, CAST(min_x + max_x AS DOUBLE) / 4 AS cx, CAST(min_y + max_y AS DOUBLE) / 4 AS cy,
  CAST(max_x - min_x AS DOUBLE) / 2 AS bw, CAST(max_y - min_y AS DOUBLE) / 2 AS bh, confidence AS conf,
  CAST(0.5 AS DOUBLE) AS scale, 1000 AS img_w, 1300 AS img_h FROM {boxes}""",
    "ocr_texts": """SELECT doc_id,
  CASE WHEN doc_id % 10 = 9 THEN repeat(CASE WHEN doc_id % 20 = 9 THEN 'ゴ' ELSE 'ドン' END, CAST(1 + doc_id % 9 AS INT))
    WHEN doc_id % 4 = 0 THEN translate(f, 'abcdefghijklmnopqrstuvwxyz', 'あいうえおかきくけこさしすせそたちつてと日本語人大小')
    WHEN doc_id % 4 = 1 THEN translate(f, 'abcdefghijklmnopqrstuvwxyz', 'アイウエオカキクケコサシスセソタチツテトナニヌネノハ')
    WHEN doc_id % 4 = 2 THEN f ELSE translate(f, 'aeioun', 'あえいおうン') END AS ocr_text
  FROM (SELECT doc_id, lower(substr(text, CAST(1 + doc_id % 50 AS INT), CAST(4 + doc_id % 17 AS INT))) AS f FROM {documents}) z""",
    "elements": """SELECT o_orderkey AS element_id, o_custkey AS host_page_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'img' WHEN 1 THEN 'canvas' ELSE 'background' END AS kind, o_orderstatus <> 'P' AS complete,
  CAST((o_orderkey * 37) % 400 AS INT) AS width, CAST((o_custkey * 53 + o_orderkey) % 400 AS INT) AS height,
  CAST((o_orderkey * 91) % 3000 - 600 AS INT) AS left_px, CAST((o_orderkey * 67) % 2400 - 500 AS INT) AS top_px FROM {orders}""",
    "canvas_frames": "SELECT event_id, user_id AS canvas_id, ts, CAST(floor(value) AS BIGINT) % 7 AS px_sum FROM {events}",
    "stage_timings": "SELECT event_id, event_type AS variant, value AS elapsed_ms FROM {events}",
    "yolo_labels": "SELECT doc_id AS image_id, quality AS class_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'valid' ELSE 'test' END AS split FROM {labels}",
    "hosts": "SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM {pages}",
    "patches": "SELECT vec_id, label, embedding AS px FROM {embeddings}",
}


def needs(name: str) -> list[str]:
    """Tables and views that a view reads."""
    return [x for x in (*TABLES, *VIEWS) if f"{{{x}}}" in VIEWS[name]]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder or a derived view of it."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in needs(name)})


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the views for the SQL twins; other common tables may follow after a comma."""
    order: list[str] = []

    def add(name):
        for x in needs(name):
            if x in VIEWS:
                add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    flat = {x: x for x in (*TABLES, *VIEWS)}
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{x} AS ({VIEWS[x].format(**flat)})" for x in order)
