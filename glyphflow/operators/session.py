"""Sessions of frames and replies: languages, in-band errors, partial results, memo states; and roles of model outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LANGUAGE = "English"
#: Shares of a crop's area between which the bounds of its text may lie.
LEAST_SHARE, MOST_SHARE = 0.01, 0.95
#: How long an answer may take, and how far beyond the view's edges elements count as coming.
TIMEOUT_MS, MARGIN = 30_000, 100
# The replies to a frame that holds no image, and to one whose answer takes too long.
TIMED_OUT = "WebSocket request timeout"
NO_IMAGE = "Invalid image data - could not decode"


def language_of_path(path: Column) -> Column:
    """The target language that a session's path names after /translate/, else English."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "/translate/([^/?#]+)", 1), F.lit("")), F.lit(LANGUAGE))


def short_id() -> Column:
    """A new random id of eight characters."""
    return F.left(F.uuid(), F.lit(8))


def elapsed_ms(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(begin)) / F.lit(1000.0)


def replies(frames: DataFrame, content: str, path: str, answer: Column) -> DataFrame:
    """One reply a frame: target_language, success, error in-band, and the answer where there is an image.

    Works on tables and streams; order is the caller's sequence column, which stays.
    """
    bad = F.col(content).isNull() | (F.octet_length(F.col(content)) == 0)
    return frames.withColumns({"target_language": language_of_path(F.col(path)), "success": ~bad, "error": F.when(bad, NO_IMAGE), "answer": F.when(~bad, answer)}).drop(content, path)


def connections(calls: DataFrame, session: str, order: str, language: str, took_ms: str) -> DataFrame:
    """Adds connection, opened, and error to a session's calls: a connection lasts until the language changes.

    Null languages count as one language. Calls whose answer takes longer than TIMEOUT_MS fail, and the connection stays.
    """
    w = W.partitionBy(session).orderBy(order)
    lang = F.struct(language)
    rows = calls.withColumn("opened", ~F.lag(lang).over(w).eqNullSafe(lang))
    return rows.withColumns({"connection": F.count_if("opened").over(w.rowsBetween(W.unboundedPreceding, 0)), "error": F.when(F.col(took_ms) > TIMEOUT_MS, TIMED_OUT)})


def entered_view(places: DataFrame, key: str, order: str, width: int, height: int, margin: int = MARGIN) -> DataFrame:
    """The observations at which an element comes into the view, widened by the margin; the first counts if it is inside.

    places: key, order and left_px, top_px, width, height. Touching edges are inside.
    """
    c = F.col
    inside = (c("left_px") <= width + margin) & (c("left_px") + c("width") >= -margin) & (c("top_px") <= height + margin) & (c("top_px") + c("height") >= -margin)
    rows = places.withColumn("_in", F.coalesce(inside, F.lit(False)))
    return rows.withColumn("_was", F.lag("_in", 1, False).over(W.partitionBy(key).orderBy(order))).where("_in and not _was").drop("_in", "_was")


def debug_timing(frame: Column, total: Column, **stages: Column) -> Column:
    """The debug part of a reply: bytes of the frame, each stage, their sum, what they leave of the total; two decimals."""
    whole = reduce(lambda a, b: a + b, stages.values())
    parts = {**{f"{k}_ms": v for k, v in stages.items()}, "measured_sum_ms": whole, "gap_ms": total - whole, "request_total_ms": total}
    return F.struct(F.octet_length(frame).alias("ws_frame_bytes"), *[F.round(v, 2).alias(k) for k, v in parts.items()])


def partial_results(boxes: DataFrame, images: DataFrame, key: str, order: str) -> DataFrame:
    """key, seq, done and the boxes' other columns: each image's boxes in order, then a last row that only says done."""
    fields = [c for c in boxes.columns if c not in (key, order)]
    rows = boxes.select(key, (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("int").alias("seq"), F.lit(False).alias("done"), *fields)
    sizes = boxes.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    last = images.select(key).distinct().join(sizes, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("seq"), F.lit(True).alias("done"))
    return rows.unionByName(last, allowMissingColumns=True)


def memo_states(calls: DataFrame, session: str, key: str, order: str, clear: str, failed: str) -> DataFrame:
    """Adds epoch and hit to a session's calls: a call with the clear flag empties the memo first; failed calls aren't kept.

    A session's calls are sorted, and so is each key's part of an epoch; only counts are carried.
    """
    epoch = F.count_if(F.col(clear)).over(W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    before = W.partitionBy(session, "epoch", key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return calls.withColumn("epoch", epoch).withColumn("hit", F.coalesce(F.bool_or(~F.col(failed)).over(before), F.lit(False)))


def origins(listed: Column) -> Column:
    """Allowed origins of a comma-separated list, without blanks at their ends."""
    return F.transform(F.split(listed, ","), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))


def toggle_title(enabled: Column, host: Column) -> Column:
    return F.concat(F.when(enabled, "Disable").otherwise("Enable"), F.lit(" translation for "), host)


# The names of the supported languages' labels.
LABELS = {"ar": "Arabic", "de": "German", "en": "English", "es": "Spanish", "fr": "French", "hi": "Hindi", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "pl": "Polish", "pt-BR": "BrazilianPortuguese", "pt-PT": "Portuguese", "ru": "Russian", "th": "Thai", "vi": "Vietnamese", "zh-CN": "ChineseSimplified", "zh-TW": "ChineseTraditional"}


def language_label(code: Column) -> Column:
    """The message key of a language's label; Unknown for others."""
    keys = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, f"translateTo{v}Label")])
    return F.coalesce(F.try_element_at(keys, code), F.lit("Unknown"))


def sane_bounds(area: Column, crop_area: Column) -> Column:
    """Bounds that hold neither next to nothing nor nearly all of a crop."""
    return (area >= crop_area * F.lit(LEAST_SHARE)) & (area <= crop_area * F.lit(MOST_SHARE))


def confident_boxes(found: DataFrame, size: int, least: float = 0.5) -> DataFrame:
    """min_x to max_y of normalised boxes (cx, cy, bw, bh, conf) over the least confidence, in pixels, cut to the image; empty ones go."""
    c = F.col
    low = lambda at, side: F.greatest(F.lit(0), ((c(at) - c(side) / 2) * size).cast("int"))
    top = lambda at, side: F.least(F.lit(size), ((c(at) + c(side) / 2) * size).cast("int"))
    rows = found.where(c("conf") > least).withColumns({"min_x": low("cx", "bw"), "min_y": low("cy", "bh"), "max_x": top("cx", "bw"), "max_y": top("cy", "bh")})
    return rows.where((c("max_x") > c("min_x")) & (c("max_y") > c("min_y"))).drop("cx", "cy", "bw", "bh")


def edge_thresholds(grey: Column) -> list[Column]:
    """median, lower and upper: the thresholds of edge detection, a third below and above the median grey."""
    order = F.array_sort(grey)
    n = F.size(order)
    median = (F.get(order, ((n - 1) / 2).cast("int")) + F.get(order, (n / 2).cast("int"))) / 2
    return [median.alias("median"), F.greatest(F.lit(0.0), median * F.lit(1.0 - 0.33)).cast("int").alias("lower"), F.least(F.lit(255.0), median * F.lit(1.0 + 0.33)).cast("int").alias("upper")]


def output_roles(outputs: DataFrame, key: str) -> DataFrame:
    """key, blocks, mask and lines: which of a model's outputs (name, ndim, pos) has which role, by name, then by shape.

    Names with blk or box, then with mask or seg, then with det, line, db or prob; the last of each kind. Blocks without such
    a name are the first output of three dimensions; mask and lines come from the first two others of three or four.
    """
    o = outputs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.lower("name").alias("name"), "ndim"))).alias("o"))
    kind = lambda pattern, *but: F.filter("o", lambda x: F.rlike(x["name"], F.lit(pattern)) & ~F.rlike(x["name"], F.lit("|".join(but) or "^$")))
    last = lambda found: F.get(found, F.size(found) - 1)["pos"]
    o = o.withColumn("named", F.struct(last(kind("blk|box")).alias("blocks"), last(kind("mask|seg", "blk|box")).alias("mask"), last(kind("det|line|db|prob", "blk|box", "mask|seg")).alias("lines")))
    o = o.withColumn("blocks", F.coalesce("named.blocks", F.get(F.filter("o", lambda x: x["ndim"] == 3), F.lit(0))["pos"]))
    o = o.withColumn("c", F.filter("o", lambda x: ~x["pos"].eqNullSafe(F.col("blocks")) & x["ndim"].isin(3, 4)))
    c0, c1, n = F.get("c", F.lit(0))["pos"], F.get("c", F.lit(1))["pos"], F.size("c")
    mask, lines = F.col("named.mask"), F.col("named.lines")
    both = mask.isNull() & lines.isNull()
    got_lines = F.when(lines.isNotNull(), lines).when(n >= 2, F.when(both, c1).otherwise(F.when(c0 != mask, c0).otherwise(c1))).when(n == 1, c0)
    got_mask = F.when(mask.isNotNull(), mask).when(n >= 2, F.when(both, c0).otherwise(F.when(c0 != lines, c0).otherwise(c1))).when((n == 1) & lines.isNotNull(), c0)
    return o.select(key, "blocks", got_mask.alias("mask"), got_lines.alias("lines"))
