"""Column functions and small operators for layout: scaling, font sizes, wrapping, colours, draw order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import geometry as G


def rescale(b: Column, target_w: int, target_h: int, width: int, height: int) -> Column:
    """Edges in the target's pixels, rounded half up."""
    sx, sy = F.lit(float(target_w)) / width, F.lit(float(target_h)) / height
    return F.struct(G.js_round(sx * b["min_x"]).alias("min_x"), G.js_round(sy * b["min_y"]).alias("min_y"), G.js_round(sx * b["max_x"]).alias("max_x"), G.js_round(sy * b["max_y"]).alias("max_y"))


def resized(w: Column, h: Column, max_w: int, max_h: int) -> list[Column]:
    """new_w and new_h; untouched if either side is within bounds, else the larger of both ratios."""
    ratio = F.greatest(F.lit(float(max_h)) / h, F.lit(float(max_w)) / w)
    fits = (w <= max_w) | (h <= max_h)
    return [F.when(fits, x.cast("long")).otherwise(G.js_round(x * ratio)).alias(n) for x, n in ((w, "new_w"), (h, "new_h"))]


def compression(chars: Column, w: Column, h: Column, max_mb: float = 2.0) -> list[Column]:
    """mb (of a base64 text of so many characters), compressed, new_w and new_h."""
    mb = chars.cast("double") * 3 / 4 / (1024 * 1024)
    scale = F.sqrt(F.lit(max_mb) / mb)
    return [mb.alias("mb"), (mb > max_mb).alias("compressed"), *[F.when(mb > max_mb, F.floor(x * scale)).otherwise(x.cast("long")).alias(n) for x, n in ((w, "new_w"), (h, "new_h"))]]


def font_size(w: Column, h: Column, n: Column) -> Column:
    """Pixels, 12 to 50, for n characters in a box; 20 for none."""
    per_line = F.greatest(F.lit(1), F.floor(w / 12))
    lines = F.greatest(F.lit(1), F.ceil(n / per_line))
    size = G.floor_div(h.cast("double"), lines * F.lit(1.2))
    return F.when(n == 0, 20).otherwise(F.greatest(F.lit(12.0), F.least(F.lit(50.0), size))).cast("int")


def refit(font: Column, lines: Column, h: Column) -> Column:
    """The font shrunk so that the lines fit the box with 20 pixels to spare, 12 at least."""
    total = lines * font * 1.25
    return F.when(total > h - 20, F.greatest(F.lit(12.0), font * ((h - 20) / total))).otherwise(font)


def vertical_centre(top: Column, h: Column, lines: Column, font: Column) -> list[Column]:
    """start_y of the first line's middle, and how many lines are drawn before the box ends."""
    line = font * 1.25
    start = F.greatest(top + (h - lines * font * 1.25) / 2 + font * 1.25 / 2, top + font * 1.25 / 2)
    drawn = F.size(F.filter(F.sequence(F.lit(0), lines - 1), lambda i: start + i * line <= top + h - line / 2))
    return [start.alias("start_y"), drawn.alias("drawn")]


def z_order(boxes: DataFrame) -> DataFrame:
    """z_index from 1, the largest box first, ties by position."""
    return boxes.withColumn("z_index", F.row_number().over(W.partitionBy("page_id").orderBy(G.area(G.box()).desc(), "box_idx")).cast("int"))


def draw_order(boxes: DataFrame) -> DataFrame:
    """draw_pos from 1 by z_index; no or zero z_index counts as 1."""
    z = F.coalesce(F.nullif(F.col("z_index"), F.lit(0)), F.lit(1))
    return boxes.withColumn("draw_pos", F.row_number().over(W.partitionBy("page_id").orderBy(z, "box_idx")).cast("int"))


def debug_label(z: Column, confidence: Column) -> Column:
    shown = F.when((confidence.isNotNull()) & (confidence != 0), F.concat(F.lit(" c:"), G.js_round(confidence * 100).cast("int").cast("string"), F.lit("%"))).otherwise("")
    return F.concat(F.lit("z:"), F.coalesce(F.nullif(z, F.lit(0)), F.lit(1)).cast("string"), shown)


def wrap(text: Column, width: Column) -> Column:
    """Greedy lines of words of at most `width` characters (a longer word has a line of its own); no words: the text.

    One pattern finds all lines in one pass: a line starts at what is no space and is the longest run of words that fits, or
    else one word. A fold over the words would copy the array of lines with each line.
    """
    more = F.greatest(width - 1, F.lit(0)).cast("string")
    lines = F.regexp_extract_all(text, F.concat(F.lit("(?s)[^ ].{0,"), more, F.lit("}(?= |\\z)|[^ ]+|\\A *\\z")), F.lit(0))
    return F.coalesce(lines, F.array(text))


def grey(px: Column) -> Column:
    """Patch values to 0..255 greys."""
    return F.transform(px, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.lit(128.0) + F.lit(400.0) * v.cast("double"))))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once a row, although f uses it in lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v, lambda s: s / F.size(a))


def variance(a: Column) -> Column:
    """Of the population."""
    return let(a, lambda x: let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m), lambda s: s / F.size(x))))


def sums(px: Column, side: int = 8, columns: bool = False) -> Column:
    """Row or column sums of a square patch."""
    at = (lambda i, j: j * side + i) if columns else (lambda i, j: i * side + j)
    line = F.array(*[F.lit(k) for k in range(side)])
    return let(px, lambda p: F.transform(line, lambda i: F.aggregate(line, F.lit(0.0), lambda s, j: s + F.get(p, at(i, j)))))


def active_range(sums_: Column, share: float = 0.3) -> Column:
    """First and last place whose sum exceeds that share of the mean (1 where the mean is 0); null bounds without three such places."""
    limit = lambda m: F.when(m == 0, F.lit(1.0)).otherwise(m * share)
    over = lambda x, top: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) > top)
    places = let(sums_, lambda x: let(limit(mean(x)), lambda top: over(x, top)))
    return let(places, lambda p: F.when(F.size(p) >= 3, F.struct(F.array_min(p).alias("first"), F.array_max(p).alias("last"))))
