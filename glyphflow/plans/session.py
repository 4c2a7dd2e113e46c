"""Registered queries on sessions, model outputs and small settings, with their SQL twins (values written out)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from ..operators import discovery as D
from ..operators import session as S
from ..streaming import runs
from .fixtures import view, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PATH = "CASE conv_id % 3 WHEN 0 THEN '/ws/translate' WHEN 1 THEN '/ws/translate/Spanish' ELSE '/ws/translate/German?x=1' END"


@query("""SELECT conv_id, turn, role, CASE conv_id % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'Spanish' ELSE 'German' END AS target_language, ok AS success,
 CASE WHEN NOT ok THEN 'Invalid image data - could not decode' END AS error, CASE WHEN ok THEN md5(text) END AS answer FROM (SELECT *, turn % 5 <> 4 AND length(text) > 0 AS ok FROM conversations) z""")
def session_replies(spark, sf):
    """A stream of frames, one reply each, with the place in the session and errors in-band."""
    rows = runs.table_stream(spark, f"{sf}/conversations.parquet")
    frames = rows.select("conv_id", "turn", "role", F.when(F.col("turn") % 5 != 4, F.col("text")).otherwise("").alias("frame"), F.expr(_PATH).alias("path"))
    done = S.replies(frames, "frame", "path", F.md5("frame"))
    return runs.drained(spark, done, done.schema)


@query("SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000.0::DOUBLE AS elapsed_ms FROM events GROUP BY user_id")
def session_elapsed(spark, sf):
    e = view(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", S.elapsed_ms(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("elapsed_ms"))


@query("SELECT doc_id, 8::BIGINT AS chars, TRUE AS plain FROM documents")
def session_ids(spark, sf):
    """Random ids, so only their form is shown."""
    d = view(spark, sf, "documents").select("doc_id", S.short_id().alias("s"))
    return d.select("doc_id", F.length("s").cast("long").alias("chars"), F.rlike("s", F.lit("^[0-9a-f]{8}$")).alias("plain"))


@query(f"""{with_views("boxes")} SELECT page_id, box_idx AS seq, FALSE AS done, min_x, confidence FROM boxes
 UNION ALL SELECT o_orderkey, coalesce(n, 0)::INT, TRUE, NULL, NULL FROM orders LEFT JOIN (SELECT page_id, count(*) AS n FROM boxes GROUP BY page_id) b ON page_id = o_orderkey""")
def partial_results(spark, sf):
    boxes = view(spark, sf, "boxes").select("page_id", "box_idx", "min_x", "confidence")
    images = view(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"))
    return S.partial_results(boxes, images, "page_id", "box_idx")


@query("""SELECT event_id, epoch, coalesce(bool_or(event_id % 3 <> 0) OVER (PARTITION BY user_id, epoch, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS hit
 FROM (SELECT *, count(*) FILTER (WHERE event_id % 7 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events) z""")
def memo_epochs(spark, sf):
    e = view(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 7 == 0).alias("clear"), (F.col("event_id") % 3 == 0).alias("failed"))
    return S.memo_states(e, "user_id", "event_type", "event_id", "clear", "failed").select("event_id", "epoch", "hit")


@query("SELECT c_custkey, 'http://' || c_nationkey || '.example.com|' || c_mktsegment || '|*' AS origins FROM customer")
def allowed_origins(spark, sf):
    c = view(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" http://"), "c_nationkey", F.lit(".example.com ,\t"), "c_mktsegment", F.lit(" , *")).alias("x"))
    return c.select("c_custkey", F.array_join(S.origins(F.col("x")), "|").alias("origins"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Disable' ELSE 'Enable' END || ' translation for ' || regexp_extract(url, '^https?://([^/?#:]+)', 1) AS title FROM pages")
def toggle_titles(spark, sf):
    return view(spark, sf, "hosts").select("page_id", S.toggle_title(F.col("page_id") % 3 == 0, F.col("host")).alias("title"))


@query("""SELECT c_custkey, coalesce(MAP {'ja': 'translateToJapaneseLabel', 'pt-BR': 'translateToBrazilianPortugueseLabel', 'zh-TW': 'translateToChineseTraditionalLabel', 'en': 'translateToEnglishLabel'}[c], 'Unknown') AS label
 FROM (SELECT c_custkey, ['ja', 'pt-BR', 'zh-TW', 'en', 'xx'][1 + c_custkey % 5] AS c FROM customer) z""")
def language_labels(spark, sf):
    codes = F.array(*[F.lit(x) for x in ("ja", "pt-BR", "zh-TW", "en", "xx")])
    return view(spark, sf, "customer").select("c_custkey", S.language_label(F.get(codes, (F.col("c_custkey") % 5).cast("int"))).alias("label"))


@query(f"{with_views('boxes')} SELECT page_id, box_idx, a >= 300 * 300 * 0.01 AND a <= 300 * 300 * 0.95 AS sane FROM (SELECT page_id, box_idx, (max_x - min_x) * (max_y - min_y) AS a FROM boxes) z")
def sane_bounds(spark, sf):
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return view(spark, sf, "boxes").select("page_id", "box_idx", S.sane_bounds(area, F.lit(300 * 300)).alias("sane"))


_UNIT = "CAST(box_idx AS DOUBLE) / 8 AS cx, CAST(min_y % 64 AS DOUBLE) / 64 AS cy, CAST(min_x % 16 AS DOUBLE) / 32 AS bw, CAST(max_x % 8 AS DOUBLE) / 16 AS bh, confidence AS conf"


@query(f"""{with_views("boxes")}, u AS (SELECT page_id, box_idx, {_UNIT} FROM boxes), p AS (SELECT page_id, box_idx, conf, greatest(0, trunc((cx - bw / 2) * 640))::INT AS min_x, greatest(0, trunc((cy - bh / 2) * 640))::INT AS min_y,
 least(640, trunc((cx + bw / 2) * 640))::INT AS max_x, least(640, trunc((cy + bh / 2) * 640))::INT AS max_y FROM u WHERE conf > 0.5) SELECT * FROM p WHERE max_x > min_x AND max_y > min_y""")
def confident_boxes(spark, sf):
    return S.confident_boxes(view(spark, sf, "boxes").selectExpr("page_id", "box_idx", *_UNIT.split(", ")), 640)


@query("""SELECT vec_id, m AS median, trunc(greatest(0.0, m * (1.0::DOUBLE - 0.33::DOUBLE)))::INT AS lower, trunc(least(255.0, m * (1.0::DOUBLE + 0.33::DOUBLE)))::INT AS upper
 FROM (SELECT vec_id, list_median(list_transform(embedding, lambda v: least(255.0, greatest(0.0, 128.0 + 400.0 * CAST(v AS DOUBLE))))) AS m FROM embeddings) z""")
def edge_thresholds(spark, sf):
    return view(spark, sf, "patches").select("vec_id", *S.edge_thresholds(L.grey(F.col("px"))))


_NAME = "CASE min_x % 8 WHEN 0 THEN 'BLK' WHEN 1 THEN 'seg' WHEN 2 THEN 'det' WHEN 3 THEN 'mask' WHEN 4 THEN 'line_box' WHEN 5 THEN 'prob' WHEN 6 THEN 'out' ELSE 'x' END"


@query(f"""{with_views("boxes")}, o AS (SELECT page_id, box_idx AS pos, lower({_NAME}) AS name, 2 + min_y % 3 AS ndim FROM boxes),
 k AS (SELECT *, CASE WHEN contains(name, 'blk') OR contains(name, 'box') THEN 'b' WHEN contains(name, 'mask') OR contains(name, 'seg') THEN 'm' WHEN contains(name, 'det') OR contains(name, 'line') OR contains(name, 'db') OR contains(name, 'prob') THEN 'l' END AS kind FROM o),
 n AS (SELECT page_id, coalesce(max(pos) FILTER (WHERE kind = 'b'), min(pos) FILTER (WHERE ndim = 3)) AS blocks, max(pos) FILTER (WHERE kind = 'm') AS m, max(pos) FILTER (WHERE kind = 'l') AS l FROM k GROUP BY page_id),
 c AS (SELECT page_id, list(pos ORDER BY pos) AS c FROM o JOIN n USING (page_id) WHERE pos IS DISTINCT FROM blocks AND ndim IN (3, 4) GROUP BY page_id)
 SELECT page_id, blocks, CASE WHEN m IS NOT NULL THEN m WHEN len(c) >= 2 AND l IS NULL THEN c[1] WHEN len(c) >= 2 THEN CASE WHEN c[1] <> l THEN c[1] ELSE c[2] END WHEN len(c) = 1 AND l IS NOT NULL THEN c[1] END AS mask,
 CASE WHEN l IS NOT NULL THEN l WHEN len(c) >= 2 AND m IS NULL THEN c[2] WHEN len(c) >= 2 THEN CASE WHEN c[1] <> m THEN c[1] ELSE c[2] END WHEN len(c) = 1 THEN c[1] END AS lines FROM n LEFT JOIN c USING (page_id)""")
def output_roles(spark, sf):
    o = view(spark, sf, "boxes").selectExpr("page_id", "box_idx as pos", f"{_NAME} as name", "2 + min_y % 3 as ndim")
    return S.output_roles(o, "page_id")


@query(r"""SELECT doc_id, array_to_string(list_transform(l[:5], lambda x: CASE WHEN position('. ' IN x) > 0 THEN substr(x, position('. ' IN x) + 2) ELSE x END), '|') AS answers
 FROM (SELECT doc_id, string_split(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g'), chr(10)) AS l FROM documents) z""")
def reply_lines(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.array_join(T.numbered_reply(F.col("text"), F.lit(5)), "|").alias("answers"))


@query(f"{with_views('elements')} SELECT element_id FROM elements WHERE width >= 100 AND height >= 100 AND element_id % 4 <> 0")
def translatable(spark, sf):
    e = view(spark, sf, "elements").withColumn("translated", F.when(F.col("element_id") % 4 == 0, "true"))
    return D.translatable(e).select("element_id")


@query("""SELECT event_id, opened, count(*) FILTER (WHERE opened) OVER (PARTITION BY user_id ORDER BY event_id) AS connection, CASE WHEN ms > 30000 THEN 'WebSocket request timeout' END AS error
 FROM (SELECT event_id, user_id, (event_id * 7919) % 40000 AS ms, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type AS opened FROM events) z""")
def connections(spark, sf):
    e = view(spark, sf, "events").selectExpr("event_id", "user_id", "event_type", "(event_id * 7919) % 40000 as ms")
    return S.connections(e, "user_id", "event_id", "event_type", "ms").select("event_id", "opened", "connection", "error")


_PLACE = "event_id, user_id, CAST((event_id * 91) % 3000 - 800 AS INT) AS left_px, CAST((event_id * 67) % 2400 - 700 AS INT) AS top_px, CAST(event_id % 300 AS INT) AS width, CAST(user_id % 200 AS INT) AS height"


@query(f"""WITH p AS (SELECT {_PLACE} FROM events), i AS (SELECT event_id, user_id, left_px <= 1380 AND left_px + width >= -100 AND top_px <= 820 AND top_px + height >= -100 AS ok FROM p),
 w AS (SELECT event_id, ok, lag(ok, 1, FALSE) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM i) SELECT event_id FROM w WHERE ok AND NOT was""")
def entered_view(spark, sf):
    """Each user's events stand for the places of one element while the page scrolls."""
    places = view(spark, sf, "events").selectExpr(*_PLACE.split(", "))
    return S.entered_view(places, "user_id", "event_id", 1280, 720).select("event_id")


_STAGES = "(turn % 7) * 1.25::DOUBLE AS detection_ms, length(text) * 0.5::DOUBLE AS ocr_ms, length(text) * 0.5::DOUBLE + 100.125::DOUBLE AS total"


@query(f"""SELECT conv_id, turn, role, octet_length(encode(text))::INT AS ws_frame_bytes, round(detection_ms, 2) AS detection_ms, round(ocr_ms, 2) AS ocr_ms, round(detection_ms + ocr_ms, 2) AS measured_sum_ms,
 round(total - (detection_ms + ocr_ms), 2) AS gap_ms, round(total, 2) AS request_total_ms FROM (SELECT *, {_STAGES} FROM conversations) z""")
def debug_replies(spark, sf):
    """A stream of frames whose replies carry their timings."""
    rows = runs.table_stream(spark, f"{sf}/conversations.parquet")
    ocr = F.length("text") * 0.5
    done = rows.select("conv_id", "turn", "role", S.debug_timing(F.col("text"), ocr + 100.125, detection=(F.col("turn") % 7) * 1.25, ocr=ocr).alias("d")).select("conv_id", "turn", "role", "d.*")
    return runs.drained(spark, done, done.schema)
