"""Registered queries on recognised text and on patches, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from .fixtures import view, with_views

# The twins state the fixed values themselves, so that they also check the operators' own.
_MARKS = "。、！？「」『』（）・ー〜…"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


OCR = with_views("ocr_texts")
#: RE2 classes of the SQL twins, written out by code point.
_H, _K, _C = "\\x{3040}-\\x{309F}", "\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{FF65}-\\x{FF9F}", "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}"
_J = "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}"
_WS = "\\t\\n\\x{0B}\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _strip(t):
    return f"regexp_replace({t}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _count(t, chars):
    return f"CAST(length(regexp_replace({t}, '[^{chars}]', '', 'g')) AS INT)"


def _profile(t):
    rest = f"regexp_replace({t}, '[{_H}{_K}{_C}A-Za-z]', '', 'g')"
    other = f"CAST(length(regexp_replace(regexp_replace({rest}, '[{_MARKS}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS INT)"
    return f"CAST(length({t}) AS INT) AS total, {_count(t, _H)} AS hiragana, {_count(t, _K)} AS katakana, {_count(t, _C)} AS kanji, {_count(t, 'A-Za-z')} AS ascii_alpha, CAST(length({rest}) AS INT) - {other} AS punctuation, {other} AS other"


def _repeated(t):
    c = f"regexp_replace(regexp_replace({t}, '[{_MARKS}]', '', 'g'), '[{_WS}]', '', 'g')"
    return f"(length({c}) >= 2 AND (replace({c}, left({c}, 1), '') = '' OR (length({c}) >= 4 AND length({c}) % 2 = 0 AND replace({c}, left({c}, 2), '') = '')))"


@query(f"{OCR} SELECT doc_id, {_profile('ocr_text')} FROM ocr_texts")
def char_profile(spark, sf):
    return view(spark, sf, "ocr_texts").select("doc_id", T.profile(F.col("ocr_text")).alias("p")).select("doc_id", "p.*")


_FILTER = f"""{OCR}, p AS (SELECT doc_id, s, {_profile('s')} FROM (SELECT doc_id, {_strip('ocr_text')} AS s FROM ocr_texts) z),
 r AS (SELECT *, hiragana + katakana + kanji AS jp, CASE WHEN total - punctuation = 0 THEN 0 ELSE CAST(hiragana + katakana + kanji AS DOUBLE) / (total - punctuation) END AS ratio FROM p),
 k AS (SELECT doc_id, ratio AS japanese_ratio, CASE WHEN jp = 0 THEN 0 ELSE CAST(katakana AS DOUBLE) / jp END AS katakana_ratio, total >= 1 AND jp > 0 AND ratio >= 0.5 AND (katakana < jp OR katakana <= 6 OR {_repeated('s')}) AS keep FROM r)"""


@query(f"{_FILTER} SELECT doc_id, CAST(japanese_ratio AS DOUBLE) AS japanese_ratio, CAST(katakana_ratio AS DOUBLE) AS katakana_ratio, keep FROM k")
def japanese_filter(spark, sf):
    t = F.col("ocr_text")
    p = T.profile(T.strip(t))
    return view(spark, sf, "ocr_texts").select("doc_id", T.japanese_ratio(p).alias("japanese_ratio"), T.katakana_ratio(p).alias("katakana_ratio"), T.is_japanese(t).alias("keep"))


@query(f"{OCR} SELECT doc_id, {_repeated('ocr_text')} AS repeated FROM ocr_texts")
def repeated_pattern(spark, sf):
    return view(spark, sf, "ocr_texts").select("doc_id", T.is_repeated(F.col("ocr_text")).alias("repeated"))


_SPACED = "regexp_replace(ocr_text, '(.)', '\\1 ', 'g')"
_JOIN = lambda t: f"regexp_replace({t}, '([{_J}])[{_WS}]+([{_J}])', '\\1\\2', 'g')"


@query(f"{OCR} SELECT doc_id, {_strip(_JOIN(_JOIN(_SPACED)))} AS text FROM ocr_texts")
def normalize_spaces(spark, sf):
    return view(spark, sf, "ocr_texts").select("doc_id", T.join_spaced(F.regexp_replace("ocr_text", "(.)", "$1 ")).alias("text"))


_RAW_OUT = "CASE doc_id % 3 WHEN 0 THEN ' Assistant: ' || ocr_text || '</s>' WHEN 1 THEN ocr_text || '<|im_end|> ' ELSE '<|eot_id|>' || ocr_text || '<|im_end>' END"


def _cleaned():
    s = f"(CASE WHEN starts_with({_strip('o')}, 'Assistant:') THEN {_strip(f'substr({_strip("o")}, 11)')} ELSE {_strip('o')} END)"
    for token in ("<|im_end|>", "<|im_end>", "</s>", "<|eot_id|>"):
        s = f"replace({s}, '{token}', '')"
    return _strip(s)


@query(f"{OCR} SELECT doc_id, {_cleaned()} AS text FROM (SELECT doc_id, {_RAW_OUT} AS o FROM ocr_texts) z")
def clean_output(spark, sf):
    return view(spark, sf, "ocr_texts").select("doc_id", F.expr(_RAW_OUT).alias("o")).select("doc_id", T.clean_output(F.col("o")).alias("text"))


@query(f"{OCR} SELECT doc_id, CASE WHEN {_strip('ocr_text')} = '' THEN '' ELSE '<|im_start|>user' || chr(10) || 'Translate the following segment into English, without additional explanation.' || chr(10) || chr(10) || ocr_text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) END AS prompt FROM ocr_texts")
def build_prompt(spark, sf):
    return view(spark, sf, "ocr_texts").select("doc_id", T.prompt(F.col("ocr_text"), "English").alias("prompt"))


@query("SELECT conv_id, string_agg(CAST(n AS VARCHAR) || '. ' || t, chr(10) ORDER BY n) AS prompt FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, text AS t FROM conversations) z GROUP BY conv_id")
def batch_prompt(spark, sf):
    c = view(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    lines = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return lines.select("conv_id", T.numbered_prompt(F.transform("m", lambda x: x["text"])).alias("prompt"))


@query(f"{OCR} SELECT doc_id, ocr_text FROM ocr_texts WHERE length({_strip('ocr_text')}) > 0 AND CAST((doc_id * 7919) % 60000 AS DOUBLE) / length(ocr_text) <= 6000")
def sfx_filter(spark, sf):
    t = view(spark, sf, "ocr_texts").withColumn("area", F.expr("cast((doc_id * 7919) % 60000 as double)"))
    return t.where(F.length(T.strip(F.col("ocr_text"))) > 0).where(~T.drop_sound(F.col("area"), F.col("ocr_text"))).select("doc_id", "ocr_text")


@query(f"{_FILTER} SELECT doc_id % 25 AS page_id, count(*) AS total, count(*) FILTER (WHERE keep) AS kept, count(*) - count(*) FILTER (WHERE keep) AS filtered FROM k GROUP BY 1")
def filter_counts(spark, sf):
    k = view(spark, sf, "ocr_texts").select((F.col("doc_id") % 25).alias("page_id"), T.is_japanese(F.col("ocr_text")).alias("keep"))
    kept = F.count_if("keep")
    return k.groupBy("page_id").agg(F.count("*").alias("total"), kept.alias("kept"), (F.count("*") - kept).alias("filtered"))


@query("SELECT doc_id, left(text, 30) AS preview, CAST(length(text) AS BIGINT) AS chars FROM documents")
def text_preview(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.left("text", F.lit(30)).alias("preview"), F.length("text").cast("long").alias("chars"))


_WRAP = "CASE WHEN len(lines) > 0 THEN lines ELSE [''] END"


@query(f"""WITH RECURSIVE w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark),
 s AS (SELECT item_id, ws, 1 AS k, CAST([] AS VARCHAR[]) AS lines, '' AS now FROM w
 UNION ALL SELECT item_id, ws, k + 1, CASE WHEN length(CASE WHEN now <> '' THEN now || ' ' || ws[k] ELSE ws[k] END) > 24 AND now <> '' THEN list_append(lines, now) ELSE lines END,
 CASE WHEN length(CASE WHEN now <> '' THEN now || ' ' || ws[k] ELSE ws[k] END) > 24 AND now <> '' THEN ws[k] WHEN now <> '' THEN now || ' ' || ws[k] ELSE ws[k] END FROM s WHERE k <= len(ws))
 SELECT item_id, CAST(len(l) AS INT) AS n_lines, array_to_string(l, '|') AS wrapped FROM (SELECT item_id, CASE WHEN now <> '' THEN list_append(lines, now) ELSE lines END AS l FROM s WHERE k = len(ws) + 1) z""")
def word_wrap(spark, sf):
    b = view(spark, sf, "benchmark").select("item_id", L.wrap(F.col("text"), F.lit(24)).alias("l"))
    return b.select("item_id", F.size("l").alias("n_lines"), F.array_join("l", "|").alias("wrapped"))


@query()
def word_wrap_documents(spark, sf):
    """Long texts; tested by brute force, as a recursive query over their words is too slow."""
    d = view(spark, sf, "documents").select("doc_id", L.wrap(F.col("text"), F.lit(24)).alias("l"))
    return d.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "|")).alias("wrapped"))


_GREY = "WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: least(255.0, greatest(0.0, 128.0 + 400.0 * CAST(v AS DOUBLE)))) AS px FROM embeddings)"
_SUMS = f"""{_GREY}, e AS (SELECT vec_id, CAST(i AS INT) AS i, px[i * 8 + 1] + px[i * 8 + 2] + px[i * 8 + 3] + px[i * 8 + 4] + px[i * 8 + 5] + px[i * 8 + 6] + px[i * 8 + 7] + px[i * 8 + 8] AS r,
 px[i + 1] + px[i + 9] + px[i + 17] + px[i + 25] + px[i + 33] + px[i + 41] + px[i + 49] + px[i + 57] AS c FROM g, range(8) t(i))"""


@query(f"{_GREY} SELECT vec_id, CASE WHEN m < 128 THEN '#FFFFFF' ELSE '#000000' END AS font_color, CASE WHEN m < 128 THEN '#000000' ELSE '#FFFFFF' END AS stroke_color, round(m, 6) AS brightness FROM (SELECT vec_id, list_sum(px) / 64 AS m FROM g) z")
def font_colors(spark, sf):
    p = view(spark, sf, "patches").select("vec_id", L.mean(L.grey(F.col("px"))).alias("m"))
    dark = F.col("m") < 128
    return p.select("vec_id", F.when(dark, "#FFFFFF").otherwise("#000000").alias("font_color"), F.when(dark, "#000000").otherwise("#FFFFFF").alias("stroke_color"), F.round("m", 6).alias("brightness"))


@query(f"{_SUMS} SELECT vec_id, i, round(r, 6) AS row_sum, round(c, 6) AS col_sum FROM e")
def projection_profile(spark, sf):
    px = L.grey(F.col("px"))
    z = view(spark, sf, "patches").select("vec_id", F.posexplode(F.arrays_zip(L.sums(px).alias("r"), L.sums(px, columns=True).alias("c"))).alias("i", "z"))
    return z.select("vec_id", "i", F.round("z.r", 6).alias("row_sum"), F.round("z.c", 6).alias("col_sum"))


@query(f"{_SUMS} SELECT vec_id, CASE WHEN var_pop(c) > 1.3 * var_pop(r) THEN 'vertical' ELSE 'horizontal' END AS orientation FROM e GROUP BY vec_id")
def orientation(spark, sf):
    px = L.grey(F.col("px"))
    vertical = L.variance(L.sums(px, columns=True)) > L.variance(L.sums(px)) * 1.3
    return view(spark, sf, "patches").select("vec_id", F.when(vertical, "vertical").otherwise("horizontal").alias("orientation"))


#: Greys over 200 stand for edge pixels.
@query(f"""WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN least(255.0, greatest(0.0, 128.0 + 400.0 * CAST(v AS DOUBLE))) > 160 THEN 255.0 ELSE 0.0 END) AS px FROM embeddings),
 e AS (SELECT vec_id, CAST(i AS INT) AS i, px[i * 8 + 1] + px[i * 8 + 2] + px[i * 8 + 3] + px[i * 8 + 4] + px[i * 8 + 5] + px[i * 8 + 6] + px[i * 8 + 7] + px[i * 8 + 8] AS r, px[i + 1] + px[i + 9] + px[i + 17] + px[i + 25] + px[i + 33] + px[i + 41] + px[i + 49] + px[i + 57] AS c FROM g, range(8) t(i)),
 m AS (SELECT *, CASE WHEN avg(r) OVER w = 0 THEN 1 ELSE avg(r) OVER w * 0.3 END AS rt, CASE WHEN avg(c) OVER w = 0 THEN 1 ELSE avg(c) OVER w * 0.3 END AS ct FROM e WINDOW w AS (PARTITION BY vec_id)),
 b AS (SELECT vec_id, min(i) FILTER (WHERE r > rt) AS y0, max(i) FILTER (WHERE r > rt) AS y1, count(*) FILTER (WHERE r > rt) AS ny, min(i) FILTER (WHERE c > ct) AS x0, max(i) FILTER (WHERE c > ct) AS x1, count(*) FILTER (WHERE c > ct) AS nx FROM m GROUP BY vec_id)
 SELECT vec_id, CASE WHEN ok THEN x0 END AS min_x, CASE WHEN ok THEN y0 END AS min_y, CASE WHEN ok THEN x1 END AS max_x, CASE WHEN ok THEN y1 END AS max_y FROM (SELECT *, ny >= 3 AND nx >= 3 AND x1 - x0 >= 5 AND y1 - y0 >= 5 AS ok FROM b) z""")
def projection_bounds(spark, sf):
    px = F.transform(L.grey(F.col("px")), lambda v: F.when(v > 160, F.lit(255.0)).otherwise(F.lit(0.0)))
    p = view(spark, sf, "patches").select("vec_id", L.active_range(L.sums(px)).alias("y"), L.active_range(L.sums(px, columns=True)).alias("x"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x.last") - F.col("x.first") >= 5) & (F.col("y.last") - F.col("y.first") >= 5)
    return p.select("vec_id", *[F.when(ok, F.col(c)).alias(n) for c, n in (("x.first", "min_x"), ("y.first", "min_y"), ("x.last", "max_x"), ("y.last", "max_y"))])


#: The chain of bounds: projection where it holds, else the inset by 15 percent; then a margin of 2 within the crop.
@query(SQL["projection_bounds"].replace("SELECT vec_id, CASE WHEN ok", "SELECT vec_id, greatest(0, coalesce(CASE WHEN ok THEN x0 END, 1) - 2) AS min_x, greatest(0, coalesce(CASE WHEN ok THEN y0 END, 1) - 2) AS min_y, least(8, coalesce(CASE WHEN ok THEN x1 END, 7) + 2) AS max_x, least(8, coalesce(CASE WHEN ok THEN y1 END, 7) + 2) AS max_y FROM (SELECT vec_id, CASE WHEN ok", 1).split(" FROM (SELECT vec_id, CASE WHEN ok")[0] + " FROM (SELECT *, ny >= 3 AND nx >= 3 AND x1 - x0 >= 5 AND y1 - y0 >= 5 AS ok FROM b) z")
def tight_bounds(spark, sf):
    b = projection_bounds(spark, sf)
    low = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 2).alias(c)
    top = lambda c: F.least(F.lit(8), F.coalesce(F.col(c), F.lit(7)) + 2).alias(c)
    return b.select("vec_id", low("min_x"), low("min_y"), top("max_x"), top("max_y"))
