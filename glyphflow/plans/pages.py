"""Registered queries that assemble page results, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import layout as L
from ..functions import text as T
from ..operators import detection as D
from ..operators import pages as P
from . import boxes as B
from . import texts as X
from .fixtures import view, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _page_sql():
    chain = f"y AS ({B._YOLO}), k AS ({B._nms_sql('y')}), i AS ({B._inner_sql('k')}), o AS ({B._READ} i)"
    both = with_views("raw_detections", "ocr_texts")
    keep = X._FILTER.split(", p AS (", 1)[1]
    rows = """t AS (SELECT o.*, ocr_text, min_x + CAST((max_x - min_x) // 100 AS INT) AS rx0, min_y + CAST((max_y - min_y) // 100 AS INT) AS ry0, max_x - CAST((max_x - min_x) // 100 AS INT) AS rx1, max_y - CAST((max_y - min_y) // 100 AS INT) AS ry1
 FROM o JOIN ocr_texts d ON d.doc_id = (o.page_id * 7 + o.box_idx) % (SELECT count(*) FROM documents) JOIN kk ON kk.doc_id = d.doc_id AND kk.keep),
 f AS (SELECT *, rx1 - rx0 AS w, ry1 - ry0 AS h, CAST(greatest(1, ceil(CAST(length(ocr_text) AS DOUBLE) / greatest(1, (rx1 - rx0) // 12))) AS INT) AS lines, CAST(length(ocr_text) AS INT) AS n FROM t),
 z AS (SELECT *, """ + B._FONT + """ AS font, row_number() OVER (PARTITION BY page_id ORDER BY (max_x - min_x) * (max_y - min_y) DESC, read_idx) AS zi FROM f)"""
    return f"""{both}, {chain}, p AS ({keep}, kk AS (SELECT doc_id, keep FROM k0), {rows}""".replace(" k AS (SELECT doc_id, ratio", " k0 AS (SELECT doc_id, ratio")


_PAGE = _page_sql()


def page_rows(spark, sf):
    """Boxes after detection, with Japanese text joined by a number, text region, font and z-index."""
    found = D.postprocess(view(spark, sf, "raw_detections"))
    texts = view(spark, sf, "ocr_texts").where(T.is_japanese(F.col("ocr_text")))
    n = view(spark, sf, "documents").agg(F.count("*").alias("n"))  # one row
    rows = found.crossJoin(F.broadcast(n)).withColumn("doc_id", (F.col("page_id") * 7 + F.col("box_idx")) % F.col("n")).drop("n").join(texts, "doc_id")
    region = G.inset(G.box(), 1)
    rows = rows.withColumn("r", region).withColumn("font", L.font_size(F.col("r.max_x") - F.col("r.min_x"), F.col("r.max_y") - F.col("r.min_y"), F.length("ocr_text")))
    z = F.row_number().over(W.partitionBy("page_id").orderBy(G.area(G.box()).desc(), "read_idx"))
    return rows.withColumn("z_index", z)


@query(f"""{_PAGE} SELECT g.page_id, coalesce(string_agg(read_idx || ':' || min_x || ',' || min_y || ',' || max_x || ',' || max_y || '/' || rx0 || ',' || ry0 || ',' || rx1 || ',' || ry1 || ' f' || font || ' z' || zi || ' ' || ocr_text, ';' ORDER BY read_idx), '') AS boxes
 FROM (SELECT DISTINCT page_id FROM raw_detections) g LEFT JOIN z ON z.page_id = g.page_id GROUP BY g.page_id""")
def page_response(spark, sf):
    """All pages; those without boxes stay, with an empty list."""
    rows = page_rows(spark, sf)
    edges = lambda p: F.concat_ws(",", *[F.col(f"{p}{e}").cast("string") for e in G.EDGES])
    line = F.concat(F.col("read_idx"), F.lit(":"), edges(""), F.lit("/"), edges("r."), F.lit(" f"), F.col("font"), F.lit(" z"), F.col("z_index"), F.lit(" "), F.col("ocr_text"))
    lists = rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("read_idx", line.alias("t")))), lambda x: x["t"]), ";").alias("boxes"))
    pages = view(spark, sf, "boxes").select("page_id").distinct()
    return pages.join(lists, "page_id", "left").select("page_id", F.coalesce("boxes", F.lit("")).alias("boxes"))


_REQ = with_views("boxes")


@query(f"""{_REQ}, r AS (SELECT page_id // 5 AS request_id, page_id % 5 AS image_idx, box_idx AS box_pos, '{{"min_x":' || min_x || ',"min_y":' || min_y || ',"max_x":' || max_x || ',"max_y":' || max_y || '}}' AS b FROM boxes),
 i AS (SELECT o_orderkey // 5 AS request_id, o_orderkey % 5 AS image_idx FROM orders),
 l AS (SELECT i.request_id, i.image_idx, '[' || coalesce(string_agg(b, ',' ORDER BY box_pos), '') || ']' AS j FROM i LEFT JOIN r ON r.request_id = i.request_id AND r.image_idx = i.image_idx GROUP BY i.request_id, i.image_idx)
 SELECT request_id, '[' || string_agg(j, ',' ORDER BY image_idx) || ']' AS response FROM l GROUP BY request_id""")
def nested_response(spark, sf):
    rows = view(spark, sf, "boxes").selectExpr("page_id div 5 as request_id", "page_id % 5 as image_idx", "box_idx as box_pos", "min_x", "min_y", "max_x", "max_y")
    images = view(spark, sf, "orders").selectExpr("o_orderkey div 5 as request_id", "o_orderkey % 5 as image_idx").distinct()
    return P.respond(images, rows, ["min_x", "min_y", "max_x", "max_y"])


@query(f"{_REQ} SELECT page_id, box_idx, CAST((page_id % 1000) * 1000 AS DOUBLE) / count(*) OVER (PARTITION BY page_id) AS each_ms FROM boxes")
def even_timing(spark, sf):
    b = view(spark, sf, "boxes")
    return b.select("page_id", "box_idx", P.even_timing(b, "page_id", ((F.col("page_id") % 1000) * 1000).cast("double")).alias("each_ms"))


_SUM = "CASE event_type WHEN 'click' THEN v / 4 ELSE v / 2 END"


@query("SELECT event_id, round(v, 2) AS total_ms, round(a + b + c, 2) AS measured_sum_ms, round(v - (a + b + c), 2) AS gap_ms FROM (SELECT event_id, v, v / 4 AS a, v / 8 AS b, v / 2 AS c FROM (SELECT event_id, floor(value * 8) AS v FROM events) y) z")
def timing_rollup(spark, sf):
    e = view(spark, sf, "events").select("event_id", F.floor(F.col("value") * 8).cast("double").alias("v"))
    parts = F.col("v") / 4 + F.col("v") / 8 + F.col("v") / 2
    return e.select("event_id", F.round("v", 2).alias("total_ms"), F.round(parts, 2).alias("measured_sum_ms"), F.round(F.col("v") - parts, 2).alias("gap_ms"))


@query("SELECT user_id AS request_id, arg_min(value, event_id) AS first_ms, arg_min(event_type, event_id) AS first_stage, count(*) AS images FROM events GROUP BY user_id")
def first_image_timing(spark, sf):
    return view(spark, sf, "events").groupBy(F.col("user_id").alias("request_id")).agg(F.min_by("value", "event_id").alias("first_ms"), F.min_by("event_type", "event_id").alias("first_stage"), F.count("*").alias("images"))


@query("SELECT user_id AS session_id, max_by(props, event_id) FILTER (WHERE event_type <> 'view' AND props IS NOT NULL) AS debug FROM events GROUP BY user_id")
def last_debug(spark, sf):
    seen = (F.col("event_type") != "view") & F.col("props").isNotNull()
    return view(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max_by(F.when(seen, F.col("props")), F.when(seen, F.col("event_id"))).alias("debug"))


_OCR = with_views("ocr_texts")


@query(f"{_OCR}, o AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN trim(ocr_text) ELSE ocr_text END AS t FROM ocr_texts WHERE doc_id % 11 <> 0) SELECT a.doc_id, a.ocr_text AS batched, coalesce(o.t, '') AS sequential, a.ocr_text = coalesce(o.t, '') AS same FROM ocr_texts a LEFT JOIN o ON a.doc_id = o.doc_id")
def ocr_compare(spark, sf):
    a = view(spark, sf, "ocr_texts")
    other = a.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.trim("ocr_text")).otherwise(F.col("ocr_text")).alias("sequential"))
    met = P.by_position(a.withColumnRenamed("ocr_text", "batched"), other, ["doc_id"], "sequential", F.lit(""))
    return met.select("doc_id", "batched", "sequential", F.col("batched").eqNullSafe(F.col("sequential")).alias("same"))


_EL = with_views("elements", "boxes")


@query(f"{_EL}, b AS (SELECT page_id, count(*) AS n FROM boxes GROUP BY page_id) SELECT element_id, coalesce(n, 0) AS n_boxes FROM elements LEFT JOIN b ON page_id = element_id")
def response_join(spark, sf):
    counted = view(spark, sf, "boxes").groupBy(F.col("page_id").alias("element_id")).agg(F.count("*").alias("n_boxes"))
    return P.by_position(view(spark, sf, "elements").select("element_id"), counted, ["element_id"], "n_boxes", F.lit(0).cast("long"))


@query("SELECT conv_id, CAST(i AS INT) AS pos, r AS role, t AS text FROM (SELECT conv_id, unnest(range(least(len(rs), len(ts)))) AS i, unnest(rs[:least(len(rs), len(ts))]) AS r, unnest(ts[:least(len(rs), len(ts))]) AS t FROM (SELECT conv_id, list(role ORDER BY turn, role, text) AS rs, list(text ORDER BY turn, role, text)[2:] AS ts FROM conversations GROUP BY conv_id) y) z")
def parallel_arrays(spark, sf):
    c = view(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    rs, ts = F.transform("m", lambda x: x["role"]).alias("role"), F.slice(F.transform("m", lambda x: x["text"]), F.lit(2), F.size("m")).alias("text")
    return c.select("conv_id", rs, ts).select("conv_id", F.posexplode(P.zip_shortest(F.col("role"), F.col("text"))).alias("pos", "z")).select("conv_id", "pos", "z.role", "z.text")
