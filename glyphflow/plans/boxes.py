"""Registered queries on boxes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import layout as L
from ..operators import detection as D
from .fixtures import view, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BOXES = with_views("boxes")
RAW = with_views("raw_detections")


@query(f"{BOXES} SELECT page_id, box_idx, (max_x - min_x) * (max_y - min_y) AS area FROM boxes")
def box_area(spark, sf):
    return view(spark, sf, "boxes").select("page_id", "box_idx", G.area(G.box()).alias("area"))


@query(f"{BOXES} SELECT page_id, box_idx, greatest(0, min_x - 5) AS min_x, greatest(0, min_y - 5) AS min_y, least(1000, max_x + 5) AS max_x, least(1300, max_y + 5) AS max_y FROM boxes")
def crop_rect(spark, sf):
    return D.spread(view(spark, sf, "boxes").select("page_id", "box_idx", G.crop(G.box(), F.lit(1000), F.lit(1300)).alias("b")))


def _inset_sql(p):
    dx, dy = f"CAST((max_x - min_x) * {p} // 100 AS INT)", f"CAST((max_y - min_y) * {p} // 100 AS INT)"
    return f"{BOXES} SELECT page_id, box_idx, min_x + {dx} AS min_x, min_y + {dy} AS min_y, max_x - {dx} AS max_x, max_y - {dy} AS max_y FROM boxes"


@query(_inset_sql(1))
def inset_region(spark, sf):
    return D.spread(view(spark, sf, "boxes").select("page_id", "box_idx", G.inset(G.box(), 1).alias("b")))


@query(_inset_sql(15))
def inset_region_wide(spark, sf):
    return D.spread(view(spark, sf, "boxes").select("page_id", "box_idx", G.inset(G.box(), 15).alias("b")))


_YOLO = """SELECT * FROM (SELECT page_id, box_idx, conf AS confidence,
 CAST(trunc(least(greatest((cx - bw / 2) / scale, 0), img_w)) AS INT) AS min_x, CAST(trunc(least(greatest((cy - bh / 2) / scale, 0), img_h)) AS INT) AS min_y,
 CAST(trunc(least(greatest((cx + bw / 2) / scale, 0), img_w)) AS INT) AS max_x, CAST(trunc(least(greatest((cy + bh / 2) / scale, 0), img_h)) AS INT) AS max_y
 FROM raw_detections WHERE conf >= CAST(0.272 AS DOUBLE)) d WHERE max_x > min_x AND max_y > min_y"""


@query(f"{RAW} {_YOLO}")
def yolo_decode(spark, sf):
    return D.decode_yolo(view(spark, sf, "raw_detections"))


#: Rows in the three forms that the decoder tells apart: relative corners, centre format with a large centre, corners; one in seven is too short.
_DETS = """SELECT page_id, box_idx, scale, img_w, img_h, CASE WHEN box_idx % 7 = 6 THEN {a}(cx, cy, bw, bh)
 WHEN box_idx % 3 = 0 THEN {a}((cx - bw / 2) / 640, (cy - bh / 2) / 640, (cx + bw / 2) / 640, (cy + bh / 2) / 640, conf)
 WHEN box_idx % 3 = 1 THEN {a}(cx, cy, bw, bh, conf, CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE))
 ELSE {a}(cx - bw / 2, cy - bh / 2, cx + bw / 2, cy + bh / 2, conf, CAST(1 AS DOUBLE)) END AS det FROM {r}"""


def _ctd_sql():
    dets = _DETS.format(a="list_value", r="raw_detections")
    clip = lambda e, m: f"CAST(trunc(least(greatest({e} / scale, 0), {m})) AS INT)"
    return f"""{RAW}, d AS ({dets}), c AS (SELECT *, CASE WHEN list_max(det[1:4]) <= 1.5 THEN list_transform(det[1:4], lambda v: v * 640) ELSE det[1:4] END AS c,
 CASE WHEN len(det) > 5 THEN det[5] * list_max(det[6:]) ELSE det[5] END AS confidence FROM d WHERE len(det) >= 5),
 e AS (SELECT *, CASE WHEN c[3] < c[1] OR c[4] < c[2] THEN [c[1] - c[3] / 2, c[2] - c[4] / 2, c[1] + c[3] / 2, c[2] + c[4] / 2] ELSE c END AS e FROM c WHERE confidence >= CAST(0.4 AS DOUBLE))
 SELECT * FROM (SELECT page_id, box_idx, confidence, {clip('e[1]', 'img_w')} AS min_x, {clip('e[2]', 'img_h')} AS min_y, {clip('e[3]', 'img_w')} AS max_x, {clip('e[4]', 'img_h')} AS max_y FROM e) z WHERE max_x > min_x AND max_y > min_y"""


@query(_ctd_sql())
def ctd_decode(spark, sf):
    return D.decode_ctd(spark.sql(_DETS.format(a="array", r="{r}"), r=view(spark, sf, "raw_detections")))


@query(f"{BOXES} SELECT page_id, box_idx, least(CAST(640 AS DOUBLE) / h, CAST(640 AS DOUBLE) / w) AS scale, greatest(1, CAST(trunc(w * least(CAST(640 AS DOUBLE) / h, CAST(640 AS DOUBLE) / w)) AS INT)) AS new_w, greatest(1, CAST(trunc(h * least(CAST(640 AS DOUBLE) / h, CAST(640 AS DOUBLE) / w)) AS INT)) AS new_h FROM (SELECT page_id, box_idx, max_x - min_x AS w, max_y - min_y AS h FROM boxes) z")
def letterbox_dims(spark, sf):
    b = view(spark, sf, "boxes").selectExpr("page_id", "box_idx", "max_x - min_x as w", "max_y - min_y as h")
    scale = F.least(F.lit(640.0) / F.col("h"), F.lit(640.0) / F.col("w"))
    fit = lambda c: F.greatest(F.lit(1), (F.col(c) * scale).cast("int"))
    return b.select("page_id", "box_idx", scale.alias("scale"), fit("w").alias("new_w"), fit("h").alias("new_h"))


@query(f"{BOXES} SELECT page_id, box_idx, " + ", ".join(f"CAST(floor(CAST({t} AS DOUBLE) / {o} * {e} + 0.5) AS BIGINT) AS {e}" for e, t, o in (("min_x", 777, 1000), ("min_y", 911, 1300), ("max_x", 777, 1000), ("max_y", 911, 1300))) + " FROM boxes")
def scale_boxes(spark, sf):
    return D.spread(view(spark, sf, "boxes").select("page_id", "box_idx", L.rescale(G.box(), 777, 911, 1000, 1300).alias("b")))


@query(f"{BOXES} SELECT page_id, box_idx, CAST(CASE WHEN w <= 1800 OR h <= 1800 THEN w ELSE floor(w * greatest(CAST(1800 AS DOUBLE) / h, CAST(1800 AS DOUBLE) / w) + 0.5) END AS BIGINT) AS new_w, CAST(CASE WHEN w <= 1800 OR h <= 1800 THEN h ELSE floor(h * greatest(CAST(1800 AS DOUBLE) / h, CAST(1800 AS DOUBLE) / w) + 0.5) END AS BIGINT) AS new_h FROM (SELECT page_id, box_idx, (max_x - min_x) * 17 AS w, (max_y - min_y) * 13 AS h FROM boxes) z")
def resize_ratio(spark, sf):
    b = view(spark, sf, "boxes").selectExpr("page_id", "box_idx", "(max_x - min_x) * 17 as w", "(max_y - min_y) * 13 as h")
    return b.select("page_id", "box_idx", *L.resized(F.col("w"), F.col("h"), 1800, 1800))


@query(f"{BOXES} SELECT page_id, box_idx, mb, mb > 2 AS compressed, CAST(CASE WHEN mb > 2 THEN floor((max_x - min_x) * sqrt(2 / mb)) ELSE max_x - min_x END AS BIGINT) AS new_w, CAST(CASE WHEN mb > 2 THEN floor((max_y - min_y) * sqrt(2 / mb)) ELSE max_y - min_y END AS BIGINT) AS new_h FROM (SELECT *, CAST((max_x - min_x) * (max_y - min_y) * 100 AS DOUBLE) * 3 / 4 / 1048576 AS mb FROM boxes) z")
def compress_plan(spark, sf):
    b = view(spark, sf, "boxes").withColumn("chars", G.area(G.box()) * 100)
    return b.select("page_id", "box_idx", *L.compression(F.col("chars"), F.expr("max_x - min_x"), F.expr("max_y - min_y")))


_FONT = """CAST(CASE WHEN n = 0 THEN 20 ELSE greatest(12, least(50, round((CAST(h AS DOUBLE) - CAST(h AS DOUBLE) % (lines * CAST(1.2 AS DOUBLE))) / (lines * CAST(1.2 AS DOUBLE))))) END AS INT)"""


@query(f"""{BOXES} SELECT page_id, box_idx, n, {_FONT} AS font_px FROM (SELECT *, CAST(greatest(1, ceil(CAST(n AS DOUBLE) / greatest(1, w // 12))) AS INT) AS lines FROM (SELECT page_id, box_idx, max_x - min_x AS w, max_y - min_y AS h, CAST((page_id + box_idx * 7) % 60 AS INT) AS n FROM boxes) y) z""")
def font_size(spark, sf):
    b = view(spark, sf, "boxes").selectExpr("page_id", "box_idx", "max_x - min_x as w", "max_y - min_y as h", "cast((page_id + box_idx * 7) % 60 as int) as n")
    return b.select("page_id", "box_idx", "n", L.font_size(F.col("w"), F.col("h"), F.col("n")).alias("font_px"))


@query(f"""{BOXES}, x AS (SELECT page_id, box_idx, min_y, max_y - min_y AS h, CAST(1 + (page_id + box_idx) % 9 AS INT) AS lines, CAST(20 AS DOUBLE) AS font FROM boxes),
 y AS (SELECT *, CASE WHEN lines * font * 1.25 > h - 20 THEN greatest(12, font * ((h - 20) / (lines * font * 1.25))) ELSE font END AS fit FROM x)
 SELECT page_id, box_idx, CAST(fit AS DOUBLE) AS fit, CAST(greatest(min_y + (h - lines * fit * 1.25) / 2 + fit * 1.25 / 2, min_y + fit * 1.25 / 2) AS DOUBLE) AS start_y,
 CAST(len(list_filter(range(lines), lambda i: greatest(min_y + (h - lines * fit * 1.25) / 2 + fit * 1.25 / 2, min_y + fit * 1.25 / 2) + i * (fit * 1.25) <= min_y + h - fit * 1.25 / 2)) AS INT) AS drawn FROM y""")
def font_refit(spark, sf):
    b = view(spark, sf, "boxes").selectExpr("page_id", "box_idx", "min_y", "max_y - min_y as h", "cast(1 + (page_id + box_idx) % 9 as int) as lines", "20.0D as font")
    b = b.withColumn("fit", L.refit(F.col("font"), F.col("lines"), F.col("h")))
    return b.select("page_id", "box_idx", "fit", *L.vertical_centre(F.col("min_y"), F.col("h"), F.col("lines"), F.col("fit")))


@query(f"{BOXES} SELECT page_id, box_idx, min_x * (CAST(1.25 AS DOUBLE) * 2) AS left_px, min_y * (CAST(1.25 AS DOUBLE) * 2) AS top_px, (max_x - min_x) * (CAST(1.25 AS DOUBLE) * 2) AS width_px, (max_y - min_y) * (CAST(1.25 AS DOUBLE) * 2) AS height_px FROM boxes")
def snapshot_rect(spark, sf):
    k = F.lit(1.25) * F.lit(2.0)
    e = F.expr
    return view(spark, sf, "boxes").select("page_id", "box_idx", (e("min_x") * k).alias("left_px"), (e("min_y") * k).alias("top_px"), (e("max_x - min_x") * k).alias("width_px"), (e("max_y - min_y") * k).alias("height_px"))


def iou_sql(a, b):
    w = f"(least({a}.max_x, {b}.max_x) - greatest({a}.min_x, {b}.min_x))"
    h = f"(least({a}.max_y, {b}.max_y) - greatest({a}.min_y, {b}.min_y))"
    area = lambda q: f"(({q}.max_x - {q}.min_x) * ({q}.max_y - {q}.min_y))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN CAST({w} * {h} AS DOUBLE) / ({area(a)} + {area(b)} - {w} * {h}) ELSE 0.0 END)"


@query(f"{BOXES} SELECT a.page_id, a.box_idx AS a_idx, b.box_idx AS b_idx, CAST({iou_sql('a', 'b')} AS DOUBLE) AS iou FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_idx < b.box_idx WHERE {iou_sql('a', 'b')} > 0")
def iou_pairs(spark, sf):
    pairs = D.box_pairs(view(spark, sf, "boxes"))
    return pairs.select("page_id", F.col("a.box_idx").alias("a_idx"), F.col("b.box_idx").alias("b_idx"), G.iou(F.col("a"), F.col("b")).alias("iou")).where("iou > 0")


def _nms_sql(source, threshold=0.5):
    s = "{'box_idx': box_idx, 'min_x': min_x, 'min_y': min_y, 'max_x': max_x, 'max_y': max_y, 'confidence': confidence}"
    return f"""SELECT page_id, b.box_idx AS box_idx, b.min_x AS min_x, b.min_y AS min_y, b.max_x AS max_x, b.max_y AS max_y, b.confidence AS confidence FROM (SELECT page_id, unnest(list_reduce(list_transform(bs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {iou_sql('k', 'x[1]')} >= {threshold})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS b
 FROM (SELECT page_id, list({s} ORDER BY confidence DESC, box_idx) AS bs FROM {source} GROUP BY page_id) p) q"""


@query(f"{BOXES} {_nms_sql('boxes')}")
def nms_keep(spark, sf):
    return D.suppress(view(spark, sf, "boxes"))


@query(f"{BOXES} {_nms_sql('boxes', 0.2)}")
def nms_keep_strict(spark, sf):
    return D.suppress(view(spark, sf, "boxes"), 0.2)


def _inner_sql(source):
    return f"SELECT page_id, box_idx, min_x, min_y, max_x, max_y, confidence FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE b.page_id = a.page_id AND b.box_idx <> a.box_idx AND a.min_x <= b.min_x AND a.min_y <= b.min_y AND a.max_x >= b.max_x AND a.max_y >= b.max_y)"


@query(f"{BOXES} {_inner_sql('boxes')}")
def contained_filter(spark, sf):
    return D.innermost(view(spark, sf, "boxes"))


_READ = "SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min_x DESC, min_y, confidence DESC, box_idx) - 1 AS INT) AS read_idx FROM"


@query(f"{BOXES} {_READ} boxes")
def read_order(spark, sf):
    return D.reading_order(view(spark, sf, "boxes"))


@query(f"{RAW}, y AS ({_YOLO}), k AS ({_nms_sql('y')}), i AS ({_inner_sql('k')}) {_READ} i")
def detect_postprocess(spark, sf):
    return D.postprocess(view(spark, sf, "raw_detections"))


_DX = "greatest(b.min_x - a.max_x, a.min_x - b.max_x, 0)"
_DY = "greatest(b.min_y - a.max_y, a.min_y - b.max_y, 0)"
_DIST = f"sqrt(CAST({_DX} * {_DX} + {_DY} * {_DY} AS DOUBLE))"
_OVER = "(CASE WHEN least(a.max_y - a.min_y, b.max_y - b.min_y) = 0 THEN 0.0 ELSE CAST(greatest(least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y), 0) AS DOUBLE) / least(a.max_y - a.min_y, b.max_y - b.min_y) END)"
_PAIR = "FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_idx < b.box_idx"
_EDGE = f"SELECT a.page_id, a.box_idx AS a_idx, b.box_idx AS b_idx {_PAIR} WHERE {_DIST} = 0 OR ({_DIST} <= 80 AND {_OVER} >= 0.5)"


@query(f"{BOXES} SELECT a.page_id, a.box_idx AS a_idx, b.box_idx AS b_idx, {_DIST} AS distance, CAST({_OVER} AS DOUBLE) AS y_overlap {_PAIR}")
def pair_distance(spark, sf):
    a, b = F.col("a"), F.col("b")
    return D.box_pairs(view(spark, sf, "boxes")).select("page_id", a["box_idx"].alias("a_idx"), b["box_idx"].alias("b_idx"), G.distance(a, b).alias("distance"), G.y_overlap(a, b).alias("y_overlap"))


@query(f"{BOXES} {_EDGE}")
def group_edges(spark, sf):
    a, b = F.col("a"), F.col("b")
    return D.box_pairs(view(spark, sf, "boxes")).where(G.near(a, b)).select("page_id", a["box_idx"].alias("a_idx"), b["box_idx"].alias("b_idx"))


_GROUPS = f"""{with_views('boxes', recursive=True)}, e AS ({_EDGE}), both_ways AS (SELECT page_id, a_idx, b_idx FROM e UNION ALL SELECT page_id, b_idx, a_idx FROM e),
 reach AS (SELECT page_id, box_idx, box_idx AS root FROM boxes UNION SELECT r.page_id, w.b_idx, r.root FROM reach r JOIN both_ways w ON w.page_id = r.page_id AND w.a_idx = r.box_idx),
 groups AS (SELECT page_id, box_idx, min(root) AS group_id FROM reach GROUP BY page_id, box_idx)"""


@query(f"{_GROUPS} SELECT * FROM groups")
def group_components(spark, sf):
    return D.group_numbers(view(spark, sf, "boxes"))


@query(f"""{_GROUPS}, m AS (SELECT b.*, g.group_id FROM boxes b JOIN groups g ON b.page_id = g.page_id AND b.box_idx = g.box_idx),
 u AS (SELECT page_id, group_id, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, round(avg(confidence), 6) AS confidence, string_agg('t' || box_idx, '' ORDER BY -(min_x + max_x), min_y + max_y, box_idx) AS text, CAST(count(*) AS INT) AS members FROM m GROUP BY page_id, group_id)
 SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY -(min_x + max_x), min_y + max_y, group_id) - 1 AS INT) AS group_pos FROM u""")
def group_boxes(spark, sf):
    b = view(spark, sf, "boxes").withColumn("text", F.concat(F.lit("t"), F.col("box_idx")))
    return D.merge_groups(b).withColumn("confidence", F.round("confidence", 6))


_PAIR = "list_filter(flatten(list_transform(range(1, len(bs) + 1), lambda i: list_transform(range(i + 1, len(bs) + 1), lambda j: {'i': i, 'j': j, 'a': bs[i], 'b': bs[j]}))), lambda p: p.a.x0 - 30 <= p.b.x1 AND p.a.x1 + 30 >= p.b.x0 AND p.a.y0 - 30 <= p.b.y1 AND p.a.y1 + 30 >= p.b.y0)[1]"


@query(f"""{with_views("boxes", recursive=True)}, r AS (SELECT page_id, 0 AS step, list({{'x0': min_x, 'y0': min_y, 'x1': max_x, 'y1': max_y}}) AS bs FROM boxes WHERE (max_x - min_x) * (max_y - min_y) >= 100 GROUP BY page_id
 UNION ALL SELECT page_id, step + 1, list_append(list_transform(list_filter(range(1, len(bs) + 1), lambda k: k <> p.i AND k <> p.j), lambda k: bs[k]), {{'x0': least(p.a.x0, p.b.x0), 'y0': least(p.a.y0, p.b.y0), 'x1': greatest(p.a.x1, p.b.x1), 'y1': greatest(p.a.y1, p.b.y1)}})
 FROM (SELECT *, {_PAIR} AS p FROM r) z WHERE p IS NOT NULL), d AS (SELECT page_id, unnest(arg_max(bs, step)) AS b FROM r GROUP BY page_id)
 SELECT page_id, b.x0 AS min_x, b.y0 AS min_y, b.x1 AS max_x, b.y1 AS max_y, 0.9::DOUBLE AS confidence FROM d WHERE (b.x1 - b.x0) * (b.y1 - b.y0) >= 500""")
def derive_blocks(spark, sf):
    return D.derive_blocks(view(spark, sf, "boxes").where("(max_x - min_x) * (max_y - min_y) >= 100"))


@query(f"""{BOXES}, l AS (SELECT page_id, box_idx, min_x + 3 AS min_x, min_y + 3 AS min_y, max_x - 3 AS max_x, min_y + 20 AS max_y FROM boxes),
 f AS (SELECT l.page_id, l.box_idx AS line_idx, min(b.box_idx) AS box_idx FROM l JOIN boxes b ON l.page_id = b.page_id AND (l.min_x + l.max_x) / 2.0 BETWEEN b.min_x AND b.max_x AND (l.min_y + l.max_y) / 2.0 BETWEEN b.min_y AND b.max_y GROUP BY l.page_id, l.box_idx)
 SELECT b.page_id, b.box_idx, count(f.line_idx) AS n_lines, coalesce(string_agg(CAST(f.line_idx AS VARCHAR), ',' ORDER BY f.line_idx), '') AS lines FROM boxes b LEFT JOIN f ON b.page_id = f.page_id AND b.box_idx = f.box_idx GROUP BY b.page_id, b.box_idx""")
def lines_to_blocks(spark, sf):
    b = view(spark, sf, "boxes")
    lines = b.selectExpr("page_id", "box_idx", "min_x + 3 as min_x", "min_y + 3 as min_y", "max_x - 3 as max_x", "min_y + 20 as max_y")
    return D.lines_to_blocks(b, lines).select("page_id", "box_idx", F.size("lines").cast("long").alias("n_lines"), F.concat_ws(",", F.transform("lines", lambda x: x.cast("string"))).alias("lines"))


@query(f"{BOXES} SELECT page_id, box_idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (max_x - min_x) * (max_y - min_y) DESC, box_idx) AS INT) AS z_index FROM boxes")
def zindex(spark, sf):
    return L.z_order(view(spark, sf, "boxes")).select("page_id", "box_idx", "z_index")


@query(f"{BOXES}, z AS (SELECT page_id, box_idx, CAST((page_id + box_idx * 3) % 5 AS INT) AS z FROM boxes) SELECT page_id, box_idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY coalesce(nullif(z, 0), 1), box_idx) AS INT) AS draw_pos FROM z")
def draw_order(spark, sf):
    b = view(spark, sf, "boxes").selectExpr("page_id", "box_idx", "cast((page_id + box_idx * 3) % 5 as int) as z_index")
    return L.draw_order(b).select("page_id", "box_idx", "draw_pos")


@query(f"{BOXES} SELECT page_id, box_idx, 'z:' || CASE WHEN box_idx = 0 THEN 1 ELSE box_idx END || CASE WHEN confidence <> 0 THEN ' c:' || CAST(CAST(floor(confidence * 100 + 0.5) AS INT) AS VARCHAR) || '%' ELSE '' END AS label FROM boxes")
def debug_label(spark, sf):
    return view(spark, sf, "boxes").select("page_id", "box_idx", L.debug_label(F.col("box_idx"), F.col("confidence")).alias("label"))


@query(f"{BOXES} SELECT page_id, box_idx, least(greatest(list_min([min_x, max_x - 7, min_x + 5, max_x]), 0), 999) AS min_x, least(greatest(list_min([min_y, min_y + 2, max_y, max_y - 4]), 0), 1299) AS min_y, least(greatest(list_max([min_x, max_x - 7, min_x + 5, max_x]), 0), 999) AS max_x, least(greatest(list_max([min_y, min_y + 2, max_y, max_y - 4]), 0), 1299) AS max_y FROM boxes")
def polygon_bbox(spark, sf):
    from ..operators.pages import polygon_bounds

    p = F.expr("array(array(min_x, min_y), array(max_x - 7, min_y + 2), array(min_x + 5, max_y), array(max_x, max_y - 4))")
    return D.spread(view(spark, sf, "boxes").select("page_id", "box_idx", polygon_bounds(p, 1000, 1300).alias("b")))
