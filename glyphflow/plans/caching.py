"""Registered cache, look-up and admission queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as C
from .fixtures import view, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MODEL = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'm' || (doc_id % 2) END"
_KEY = f"lang || coalesce({_MODEL}, ':unknown:') || md5(text)"


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def cache_key(spark, sf):
    return view(spark, sf, "documents").select("doc_id", C.cache_key(F.col("lang"), F.expr(_MODEL), F.col("text")).alias("key"))


@query("SELECT doc_id, md5(text) AS key, CASE WHEN substr(md5(text), 1, 1) < '8' THEN 'hit:' ELSE 'new:' END || substr(md5(text), 1, 6) AS value FROM documents")
def memo_join(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    cached = d.where(F.left("key", F.lit(1)) < "8").select("key").distinct().withColumn("value", F.concat(F.lit("hit:"), F.left("key", F.lit(6))))
    return C.memoised(d, "key", lambda k: k.withColumn("value", F.concat(F.lit("new:"), F.left("key", F.lit(6)))), cached).select("doc_id", "key", "value")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY md5(text)")
def dedup_inflight(spark, sf):
    return C.first_in_flight(view(spark, sf, "documents").select("doc_id", F.md5("text").alias("key")), "key", "doc_id")


#: One request after another: what is running of its user, and whether it is let in (fewer than three run, and none of its kind).
@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
 s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS running, FALSE AS admitted, []::STRUCT(until BIGINT, kind VARCHAR)[] AS held FROM e
 UNION ALL SELECT user_id, n, event_id, len(live), ok, CASE WHEN ok THEN list_append(live, {'until': t + 86400000000, 'kind': event_type}) ELSE live END
 FROM (SELECT *, len(live) < 3 AND len(list_filter(live, lambda x: x.kind = event_type)) = 0 AS ok FROM (SELECT e.*, list_filter(s.held, lambda x: x.until > e.t) AS live FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) y) z)
 SELECT event_id, running, admitted FROM s WHERE n > 0""")
def admission_cap(spark, sf):
    e = view(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return C.admitted(e, "user_id", "ts", 86400, order="event_id", identity="event_type").select("event_id", "running", "admitted")


@query("SELECT doc_id, CAST(doc_id % 6 AS INT) AS instance FROM documents")
def round_robin(spark, sf):
    return view(spark, sf, "documents").select("doc_id", C.round_robin(F.col("doc_id"), 6).alias("instance"))


@query("SELECT n_nationkey, CAST(a AS INT) AS attempt, CAST(1000 * pow(2, a - 1) AS BIGINT) AS wait_ms FROM nation, range(1, 3) t(a)")
def backoff_schedule(spark, sf):
    return view(spark, sf, "nation").select("n_nationkey", F.posexplode(C.backoff()).alias("attempt", "wait_ms")).withColumn("attempt", (F.col("attempt") + 1).cast("int"))


def _djb2_sql(t):
    return f"lpad(lower(to_hex(list_reduce(list_transform(list_filter(string_split({t}, ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: xor((h * 33) & 4294967295, c), CAST(5381 AS BIGINT)))), 8, '0')"


@query(f"SELECT p_partkey, {_djb2_sql('p_name')} AS hash FROM part")
def djb2_hash(spark, sf):
    return view(spark, sf, "part").select("p_partkey", C.djb2(F.col("p_name")).alias("hash"))


@query("SELECT p_partkey, " + " || ".join([_djb2_sql("p_name"), *[_djb2_sql(f"substr(p_name, CAST(ceil(length(p_name) / 4.0) AS INT) * {k} + 1, CAST(ceil(length(p_name) / 4.0) AS INT))") for k in range(4)]]) + " AS hash FROM part")
def fingerprint_hash(spark, sf):
    return view(spark, sf, "part").select("p_partkey", C.fingerprint(F.col("p_name")).alias("hash"))


_CODE = "CASE n_nationkey % 6 WHEN 0 THEN 'pt' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'zh-TW' WHEN 3 THEN 'xx-YY' WHEN 4 THEN 'de' ELSE 'ja-JP' END"
# The twins state the fixed values themselves, so that they also check the operators' own.
_LANGS = "['ar', 'de', 'en', 'es', 'fr', 'hi', 'id', 'it', 'ja', 'ko', 'pl', 'pt-BR', 'pt-PT', 'ru', 'th', 'vi', 'zh-CN', 'zh-TW']"
_OWN_FONTS = {"ar": "NotoSansAR-Regular", "hi": "NotoSansHI-Regular", "ja": "NotoSansJP-Regular", "ko": "NoonnuBasicGothicRegular", "th": "NotoSansTH-Regular", "vi": "BlambotClassiciCiel-Regular", "zh-CN": "system-ui", "zh-TW": "system-ui"}
_LANG = f"(CASE WHEN list_contains({_LANGS}, c) THEN c ELSE coalesce(list_filter({_LANGS}, lambda x: starts_with(x, string_split(c, '-')[1]))[1], 'en') END)"


@query(f"SELECT n_nationkey, {_LANG} AS code, {_LANG} IN ('ja', 'zh-CN', 'zh-TW') AS vertical FROM (SELECT n_nationkey, {_CODE} AS c FROM nation) z")
def lang_fallback(spark, sf):
    n = view(spark, sf, "nation").select("n_nationkey", C.language_or_default(F.expr(_CODE)).alias("code"))
    return n.withColumn("vertical", F.col("code").isin(*C.VERTICAL))


_OPTIONS = "CASE c " + " ".join(f"WHEN '{k}' THEN ['{v}']" for k, v in _OWN_FONTS.items()) + f" ELSE CASE WHEN list_contains({_LANGS}, c) THEN ['CC Wild Words', 'CC Victory Speech'] ELSE CAST([] AS VARCHAR[]) END END"


@query(f"""SELECT c_custkey, font, CASE font WHEN 'CC Victory Speech' THEN CAST(1.05 AS DOUBLE) WHEN 'NoonnuBasicGothicRegular' THEN 1.25 ELSE 1.13 END AS line_height FROM (SELECT c_custkey, CASE WHEN len(o) = 0 THEN 'system-default' WHEN len(o) = 1 THEN o[1] WHEN list_contains(o, s) THEN s ELSE 'CC Wild Words' END AS font
 FROM (SELECT c_custkey, s, {_OPTIONS} AS o FROM (SELECT c_custkey, list_append({_LANGS}, 'xx')[1 + c_custkey % 19] AS c, CASE WHEN c_custkey % 2 = 0 THEN 'CC Victory Speech' ELSE 'other' END AS s FROM customer) x) y) z""")
def font_options(spark, sf):
    codes = F.array(*[F.lit(x) for x in (*C.LANGUAGES, "xx")])
    c = view(spark, sf, "customer").select("c_custkey", F.get(codes, (F.col("c_custkey") % 19).cast("int")).alias("c"))
    font = C.font_choice(C.font_options(F.col("c")), F.when(F.col("c_custkey") % 2 == 0, "CC Victory Speech").otherwise("other"), F.lit("CC Wild Words"))
    return c.select("c_custkey", font.alias("font")).withColumn("line_height", C.line_height(F.col("font")))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Server is down or experiencing issues. Sorry for the inconvenience.' WHEN 1 THEN 'Out of translations. Server costs are expensive. Upgrade for more!' ELSE o_orderpriority END AS translated_text, CASE WHEN o_orderkey % 4 < 2 THEN 200 ELSE CAST(o_custkey AS INT) END AS max_x FROM orders""")
def error_rows(spark, sf):
    status = F.expr("case o_orderkey % 4 when 0 then 500 when 1 then 429 else 200 end")
    good = F.array(F.struct(F.lit("ja").alias("originalLanguage"), F.col("o_orderpriority").alias("translatedText"), F.lit(0).alias("minX"), F.lit(0).alias("minY"), F.col("o_custkey").cast("int").alias("maxX"), F.lit(1).alias("maxY")))
    rows = view(spark, sf, "orders").select("o_orderkey", F.explode(F.coalesce(C.error_rows(status), good)).alias("r"))
    return rows.select("o_orderkey", F.col("r.translatedText").alias("translated_text"), F.col("r.maxX").alias("max_x"))


@query("SELECT doc_id, base64(encode(text)) AS data, text AS back, CAST(length(base64(encode(text))) AS DOUBLE) * 3 / 4 / 1048576 AS mb FROM documents")
def base64_roundtrip(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.concat(F.lit("data:image/png;base64,"), C.encoded(F.col("text").cast("binary"))).alias("uri"))
    d = d.select("doc_id", C.strip_data_uri(F.col("uri")).alias("data"))
    return d.select("doc_id", "data", F.unbase64("data").cast("string").alias("back"), C.base64_mb(F.col("data")).alias("mb"))


_DIGITS = "'0123456789abcdefghijklmnopqrstuvwxyz'"


@query(f"""WITH h AS (SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda v: floor(least(255.0, greatest(0.0, 128.0 + 400.0 * CAST(v AS DOUBLE)))))) AS BIGINT) AS n FROM embeddings)
 SELECT vec_id, ltrim(substr({_DIGITS}, CAST((n // 46656) % 36 + 1 AS INT), 1) || substr({_DIGITS}, CAST((n // 1296) % 36 + 1 AS INT), 1) || substr({_DIGITS}, CAST((n // 36) % 36 + 1 AS INT), 1) || substr({_DIGITS}, CAST(n % 36 + 1 AS INT), 1), '0') AS hash FROM h""")
def px_hash36(spark, sf):
    from ..functions import layout as L

    total = F.aggregate(F.transform(L.grey(F.col("px")), lambda v: F.floor(v)), F.lit(0).cast("long"), lambda s, v: s + v)
    return view(spark, sf, "patches").select("vec_id", C.base36(total).alias("hash"))


_FRAMES = with_views("canvas_frames")


@query(f"{_FRAMES}, w AS (SELECT event_id, canvas_id, px_sum, lag(px_sum) OVER (PARTITION BY canvas_id ORDER BY ts, event_id) AS last FROM canvas_frames) SELECT event_id, canvas_id, px_sum FROM w WHERE last IS NOT NULL AND px_sum <> last")
def canvas_change(spark, sf):
    from ..streaming.canvas import changes

    return changes(view(spark, sf, "canvas_frames"))


@query("SELECT user_id AS session_id, arg_max(event_type, event_id) AS setting, max(event_id) AS seq FROM events GROUP BY user_id")
def settings_feed(spark, sf):
    return view(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max_by("event_type", "event_id").alias("setting"), F.max("event_id").alias("seq"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'none' END AS answer FROM orders")
def transport_fallback(spark, sf):
    first, second = F.expr("case when o_orderkey % 3 = 0 then o_orderpriority end"), F.expr("case when o_orderkey % 3 = 1 then o_orderstatus end")
    return view(spark, sf, "orders").select("o_orderkey", F.coalesce(first, second, F.lit("none")).alias("answer"))
