"""Registered page-scan queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as D
from .fixtures import view, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_E = with_views("elements")
_VISIBLE = "(width > 0 AND height > 0 AND top_px < 720 AND top_px + height > 0 AND left_px < 1280 AND left_px + width > 0)"
_CAND = f"SELECT *, CAST(CASE kind WHEN 'img' THEN 0 WHEN 'canvas' THEN 1 ELSE 2 END AS INT) AS source_rank FROM elements WHERE width > 100 AND height > 100 AND (kind <> 'img' OR complete) AND {_VISIBLE}"
_POS = "CAST(row_number() OVER (PARTITION BY host_page_id ORDER BY source_rank, element_id) - 1 AS INT)"


@query(f"{_E}, c AS ({_CAND}) SELECT element_id, host_page_id, kind, source_rank, {_POS} AS pos FROM c")
def candidate_union(spark, sf):
    return D.numbered(D.candidates(view(spark, sf, "elements"))).select("element_id", "host_page_id", "kind", "source_rank", "pos")


@query(f"{_E} SELECT element_id, {_VISIBLE} AS visible FROM elements")
def visible_candidates(spark, sf):
    c = F.col
    return view(spark, sf, "elements").select("element_id", D.visible(c("left_px"), c("top_px"), c("width"), c("height")).alias("visible"))


@query(f"{_E}, c AS ({_CAND}) SELECT element_id, host_page_id, kind FROM c WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = element_id AND l_returnflag = 'R')")
def unprocessed(spark, sf):
    done = view(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("element_id"))
    return D.unprocessed(D.candidates(view(spark, sf, "elements")), done).select("element_id", "host_page_id", "kind")


@query(f"{_E}, c AS ({_CAND}), p AS (SELECT element_id, host_page_id, {_POS} AS pos FROM c) SELECT element_id, host_page_id, CAST(pos // 5 AS INT) AS batch, CAST(pos % 5 AS INT) AS slot FROM p")
def batches_of_5(spark, sf):
    return D.batches(D.candidates(view(spark, sf, "elements"))).select("element_id", "host_page_id", "batch", "slot")


_H = with_views("hosts")
_PATTERNS = ["*.example.com", "*.example.org", "ththre.example.com"]


def _allow_sql(fixed):
    tests = []
    for p in _PATTERNS:
        r = p.replace(".", "\\.").replace("*", ".*") if fixed else p.replace("*", ".*").replace(".", "\\.")
        tests.append(f"regexp_matches(host, '^{r}$')")
    return f"{_H} SELECT page_id, host FROM hosts WHERE {' OR '.join(tests)}"


@query(_allow_sql(False))
def host_allowlist(spark, sf):
    return D.allowed(view(spark, sf, "hosts"), _PATTERNS).select("page_id", "host")


@query(_allow_sql(True))
def host_allowlist_fixed(spark, sf):
    return D.allowed(view(spark, sf, "hosts"), _PATTERNS, fixed=True).select("page_id", "host")


@query(f"{_H} SELECT page_id, host FROM hosts WHERE host IN ('ththre.example.com', 'm.ththth.example.net')")
def exact_host(spark, sf):
    active = F.array(F.lit("ththre.example.com"), F.lit("m.ththth.example.net"))
    return view(spark, sf, "hosts").where(F.array_contains(active, F.col("host"))).select("page_id", "host")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'English' END AS target_language, CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END AS enabled, 'auto' AS mode FROM customer""")
def settings_merge(spark, sf):
    stored = F.when((F.col("c_custkey") % 2 == 0) & (F.col("c_custkey") % 3 == 0), F.create_map(F.lit("target_language"), F.col("c_mktsegment"), F.lit("enabled"), F.lit("false"))).when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("target_language"), F.col("c_mktsegment"))).when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("enabled"), F.lit("false")))
    defaults = F.create_map(F.lit("target_language"), F.lit("English"), F.lit("enabled"), F.lit("true"), F.lit("mode"), F.lit("auto"))
    m = view(spark, sf, "customer").select("c_custkey", D.merged_settings(stored, defaults).alias("m"))
    return m.select("c_custkey", F.col("m")["target_language"].alias("target_language"), F.col("m")["enabled"].alias("enabled"), F.col("m")["mode"].alias("mode"))


_SORTED = "array_to_string(list_sort({}), ',')"


@query("SELECT c_custkey, array_to_string(CASE WHEN list_contains(l, h) THEN l ELSE list_append(l, h) END, ',') AS added, array_to_string(list_filter(l, lambda x: x <> h), ',') AS removed FROM (SELECT c_custkey, ['h0', 'h1', 'h' || c_nationkey] AS l, 'h' || (c_custkey % 5) AS h FROM customer) z")
def allow_list_edit(spark, sf):
    c = view(spark, sf, "customer").selectExpr("c_custkey", "array('h0', 'h1', concat('h', c_nationkey)) as l", "concat('h', c_custkey % 5) as h")
    return c.select("c_custkey", F.array_join(F.when(F.array_contains("l", F.col("h")), F.col("l")).otherwise(F.array_append("l", F.col("h"))), ",").alias("added"), F.array_join(F.array_remove("l", F.col("h")), ",").alias("removed"))


_STYLE = "CASE page_id % 4 WHEN 0 THEN 'url(\"' || url || '\")' WHEN 1 THEN 'url(' || url || ')' WHEN 2 THEN 'none' ELSE 'linear-gradient(red, blue)' END"


@query(f"SELECT page_id, nullif(regexp_extract({_STYLE}, 'url\\([\"'']?([^\"'')]+)[\"'']?\\)', 1), '') AS image_url FROM pages")
def css_url(spark, sf):
    return view(spark, sf, "pages").select("page_id", D.css_url(F.expr(_STYLE)).alias("image_url"))


@query("SELECT page_id, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS hostname FROM pages")
def url_host(spark, sf):
    return view(spark, sf, "pages").select("page_id", D.hostname(F.col("url")).alias("hostname"))


_MSG = "CASE WHEN o_orderkey % 5 <> 0 THEN 'x' END AS src, CASE WHEN o_orderkey % 7 = 0 THEN 'y' ELSE '' END AS data, CAST(o_orderkey % 4 AS INT) AS height, CAST(o_custkey % 3 AS INT) AS width, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'en' END AS target, o_orderkey % 11 <> 0 AS has_image"


@query(f"""SELECT o_orderkey, CASE WHEN NOT has_image THEN 'translateImage message must set image.' ELSE nullif(CASE WHEN coalesce(src, '') = '' AND data = '' THEN 'translateImage message must set image.src or image.base64Data' || chr(10) ELSE '' END || CASE WHEN height = 0 THEN 'translateImage message must set image.height' || chr(10) ELSE '' END
 || CASE WHEN width = 0 THEN 'translateImage message must set image.width' || chr(10) ELSE '' END || CASE WHEN target = '' THEN 'translateImage message must set translateTo' || chr(10) ELSE '' END, '') END AS error FROM (SELECT o_orderkey, {_MSG} FROM orders) z""")
def validate_message(spark, sf):
    o = view(spark, sf, "orders").selectExpr("o_orderkey", *[x.strip() for x in _MSG.replace("THEN 'y' ELSE '' END AS data", "THEN 'y' ELSE '' END AS data").split(", ")])
    c = F.col
    return o.select("o_orderkey", D.image_message_error(c("has_image"), c("src"), c("data"), c("height"), c("width"), c("target")).alias("error"))


@query("""SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 9 = 0 THEN 'Must supply translateTo.' || chr(10) ELSE '' END || CASE WHEN o_orderkey % 8 = 0 THEN 'Must supply dimensions of top, left, width, and height.' || chr(10) ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'top must be an integer.' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'width must be an integer.' ELSE '' END END, '') AS error FROM orders""")
def validate_snapshot(spark, sf):
    dims = F.expr("case when o_orderkey % 8 <> 0 then named_struct('top', case when o_orderkey % 5 <> 0 then 1 end, 'left', 2, 'width', case when o_orderkey % 3 <> 0 then 3 end, 'height', 4) end")
    return view(spark, sf, "orders").select("o_orderkey", D.snapshot_message_error(F.expr("case when o_orderkey % 9 = 0 then '' else 'en' end"), dims).alias("error"))


_HTML = """'<!DOCTYPE html><IMG class=x src="/i' || page_id || '.png" width="' || (60 + page_id % 100) || '" height=''120px''><!-- <img src=/no.png> --><div style="background-image: url(/b.jpg)"><canvas width=300 height=x><script>"<img src=/no.png>"</script><img>' || html"""
_ATTRIBUTE = """nullif(regexp_replace(regexp_extract(tag, '(?is)\\s{0}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1), '^["'']|["'']$', '', 'g'), '')"""
_SIDE = "CAST(nullif(regexp_extract(" + _ATTRIBUTE + ", '^\\s*([0-9]{{1,9}})\\s*(?:px)?\\s*$', 1), '') AS INT)"


@query(f"""WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace({_HTML}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<(?:img|canvas|div|section|article|main)(?:\\s[^>]*)?>') AS tags FROM pages),
 e AS (SELECT page_id, pos::INT AS pos, tags[pos + 1] AS tag FROM (SELECT page_id, tags, unnest(range(len(tags))) AS pos FROM t) z), k AS (SELECT *, lower(regexp_extract(tag, '(?i)^<([a-z]+)', 1)) AS kind FROM e)
 SELECT * FROM (SELECT page_id, pos, CASE WHEN kind IN ('div', 'section', 'article', 'main') THEN 'background' ELSE kind END AS kind, CASE WHEN kind = 'img' THEN {_ATTRIBUTE.format('src')}
 WHEN kind <> 'canvas' THEN nullif(regexp_extract({_ATTRIBUTE.format('style')}, 'url\\(["'']?([^"'')]+)["'']?\\)', 1), '') END AS url, {_SIDE.format('width')} AS width, {_SIDE.format('height')} AS height FROM k) z WHERE kind <> 'background' OR url IS NOT NULL""")
def page_elements(spark, sf):
    """The tables' pages have no pictures, so some markup goes before each."""
    p = view(spark, sf, "pages").select("page_id", F.expr(_HTML.replace("''120px''", "\\'120px\\'")).alias("html"))
    return D.elements(p, "page_id", "html")
