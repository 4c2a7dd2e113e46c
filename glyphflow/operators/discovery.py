"""Page scan: image candidates, visibility, allow-lists, batches, settings and message checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MIN_SIZE, VIEW_W, VIEW_H, BATCH = 100, 1280, 720, 5
KINDS = ("img", "canvas", "background")


def large(kind: Column, complete: Column, w: Column, h: Column) -> Column:
    """Both sides over the least size; images must be loaded too."""
    return (w > MIN_SIZE) & (h > MIN_SIZE) & ((kind != "img") | complete)


def visible(left: Column, top: Column, w: Column, h: Column) -> Column:
    return (w > 0) & (h > 0) & (top < VIEW_H) & (top + h > 0) & (left < VIEW_W) & (left + w > 0)


def candidates(elements: DataFrame) -> DataFrame:
    """The three scans one after another, each in element order: images, canvases, backgrounds; visible ones only."""
    c = F.col
    ok = large(c("kind"), c("complete"), c("width"), c("height")) & visible(c("left_px"), c("top_px"), c("width"), c("height"))
    scans = [elements.where((c("kind") == k) & ok).withColumn("source_rank", F.lit(i)) for i, k in enumerate(KINDS)]
    return reduce(DataFrame.unionByName, scans)


def translatable(elements: DataFrame) -> DataFrame:
    """The other test: both sides of at least the least size, and no mark that says translated."""
    c = F.col
    return elements.where((c("width") >= MIN_SIZE) & (c("height") >= MIN_SIZE) & ~c("translated").eqNullSafe("true"))


def numbered(rows: DataFrame, key: str = "host_page_id") -> DataFrame:
    """pos from 0 in the order of the scans."""
    return rows.withColumn("pos", (F.row_number().over(W.partitionBy(key).orderBy("source_rank", "element_id")) - 1).cast("int"))


def batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    return numbered(rows).withColumn("batch", F.floor(F.col("pos") / size).cast("int")).withColumn("slot", (F.col("pos") % size).cast("int"))


def unprocessed(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done, "element_id", "left_anti")


def wildcard(pattern: Column, fixed: bool = False) -> Column:
    """An allow-list pattern as a regular expression.

    As the page scan has it, stars become .* before dots are escaped, so *.example.com only matches names that start with
    dots; `fixed` escapes dots first.
    """
    dot = lambda p: F.replace(p, F.lit("."), F.lit("\\."))
    star = lambda p: F.replace(p, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), star(dot(pattern)) if fixed else dot(star(pattern)), F.lit("$"))


def allowed(hosts: DataFrame, patterns: list[str], fixed: bool = False) -> DataFrame:
    """Rows whose host matches some pattern; an empty list allows none. The settings' list becomes one expression."""
    tests = [F.rlike(F.col("host"), wildcard(F.lit(p), fixed)) for p in patterns]
    return hosts.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def css_url(style: Column) -> Column:
    """The address in url(...), without quotes; null for none."""
    return F.nullif(F.regexp_extract(style, "url\\([\"']?([^\"')]+)[\"']?\\)", 1), F.lit(""))


#: Elements that may have a background image, and parts of a page that hold no elements.
GROUNDS = ("div", "section", "article", "main")
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in quotes or bare; null without it."""
    value = F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)", 1)
    return F.when(value != "", F.regexp_replace(value, "^[\"']|[\"']$", ""))


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, kind, url, width and height of what may hold a picture: images, canvases, and grounds with a picture.

    From the markup alone: pos counts the opening tags of these elements, sizes are those that attributes give (null for
    none or no number), and a canvas has no url. Comments, scripts and styles are left out; a tag ends at its first >. A
    null page has no elements.
    """
    names = "|".join(("img", "canvas", *GROUNDS))
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), HIDDEN, " "), F.lit(f"(?is)<(?:{names})(?:\\s[^>]*)?>"), F.lit(0))
    each = pages.select(key, F.posexplode(tags).alias("pos", "tag"))
    kind = F.lower(F.regexp_extract("tag", "(?i)^<([a-z]+)", 1))
    each = each.select(key, "pos", F.when(kind.isin(*GROUNDS), "background").otherwise(kind).alias("kind"), "tag")
    url = F.when(F.col("kind") == "img", attribute(F.col("tag"), "src")).when(F.col("kind") == "background", css_url(attribute(F.col("tag"), "style")))
    size = lambda name: F.try_to_number(F.nullif(F.regexp_extract(attribute(F.col("tag"), name), "^\\s*([0-9]{1,9})\\s*(?:px)?\\s*$", 1), F.lit("")), F.lit("999999999")).cast("int").alias(name)
    return each.select(key, "pos", "kind", url.alias("url"), size("width"), size("height")).where((F.col("kind") != "background") | F.col("url").isNotNull())


def hostname(url: Column) -> Column:
    """Without the port."""
    return F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def merged_settings(stored: Column, defaults: Column) -> Column:
    """Stored values over the defaults."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.coalesce(F.map_contains_key(stored, k), F.lit(False))), F.coalesce(stored, F.expr("cast(map() as map<string, string>)")))


def image_message_error(has_image: Column, src: Column, data: Column, height: Column, width: Column, target: Column) -> Column:
    """All faults of a translation request in one text; null for none."""
    blank = lambda x: F.coalesce(x.cast("string"), F.lit("")).isin("", "0")
    part = lambda bad, text: F.when(bad, text + "\n").otherwise("")
    faults = F.concat(
        part(blank(src) & blank(data), "translateImage message must set image.src or image.base64Data"),
        part(blank(height), "translateImage message must set image.height"),
        part(blank(width), "translateImage message must set image.width"),
        part(blank(target), "translateImage message must set translateTo"),
    )
    return F.when(~has_image, "translateImage message must set image.").otherwise(F.nullif(faults, F.lit("")))


def snapshot_message_error(target: Column, dims: Column) -> Column:
    """dims: a struct of top, left, width, height (null: not an integer), or null."""
    part = lambda bad, text: F.when(bad, text).otherwise("")
    inner = F.concat(*[part(dims[n].isNull(), f"{n} must be an integer.") for n in ("top", "left", "width", "height")])
    faults = F.concat(part(F.coalesce(target, F.lit("")) == "", "Must supply translateTo.\n"), F.when(dims.isNull(), "Must supply dimensions of top, left, width, and height.\n").otherwise(inner))
    return F.nullif(faults, F.lit(""))
