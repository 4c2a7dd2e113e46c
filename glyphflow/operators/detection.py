"""Detection post-processing: decoding, overlap suppression, containment, merging and reading order, page by page.

Boxes of one page are folded in an array: pages are small next to the table, so each operator costs one shuffle on the
page, and none where its input is already dealt by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions.layout import let

CONFIDENCE, CTD_CONFIDENCE, NMS_IOU, MIN_LINE_AREA, MIN_BLOCK_AREA, MERGE_REACH, INPUT_SIZE = 0.272, 0.4, 0.5, 100, 500, 30, 640


def spread(df: DataFrame, column: str = "b") -> DataFrame:
    """The struct's edges as columns."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{e}").alias(e) for e in G.EDGES])


def decode_yolo(raw: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Threshold, corners in image pixels, and no boxes without area after truncation."""
    b = G.decode_center(*[F.col(c) for c in ("cx", "cy", "bw", "bh", "scale", "img_w", "img_h")])
    kept = raw.where(F.col("conf") >= confidence).select("page_id", "box_idx", F.col("conf").alias("confidence"), b.alias("b"))
    return spread(kept).where("max_x > min_x and max_y > min_y")


def decode_ctd(raw: DataFrame, confidence: float = CTD_CONFIDENCE, size: int = INPUT_SIZE) -> DataFrame:
    """raw: det (4 coordinates, objectness, class scores), scale, img_w, img_h.

    Coordinates up to 1.5 are relative to the model's input; corners out of order mean centre format; confidence is
    objectness times the best class score, if there are any.
    """
    det = F.col("det")
    at = F.when(F.array_max(F.slice(det, 1, 4)) <= 1.5, F.transform(F.slice(det, 1, 4), lambda v: v * size)).otherwise(F.slice(det, 1, 4))
    conf = F.when(F.size(det) > 5, det[4] * F.array_max(F.slice(det, 6, 1 << 20))).otherwise(det[4])
    rows = raw.where(F.size(det) >= 5).select("*", at.alias("c"), conf.alias("confidence")).where(F.col("confidence") >= confidence)
    c = F.col("c")
    centre = (c[2] < c[0]) | (c[3] < c[1])
    ends = F.when(centre, F.array(c[0] - c[2] / 2, c[1] - c[3] / 2, c[0] + c[2] / 2, c[1] + c[3] / 2)).otherwise(c)
    e, s = ends, F.col("scale")
    b = F.struct(*[G.clip_int(e[k] / s, F.col("img_w" if k % 2 == 0 else "img_h")).alias(n) for k, n in enumerate(G.EDGES)])
    return spread(rows.select("page_id", "box_idx", "confidence", b.alias("b"))).where("max_x > min_x and max_y > min_y")


def as_pages(boxes: DataFrame, *order, extra: tuple[str, ...] = ()) -> DataFrame:
    """page_id and its boxes as an array, sorted by the given columns."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*keys, "box_idx", *G.EDGES, "confidence", *extra))).alias("bs"))


def from_pages(pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return pages.select("page_id", F.explode("bs").alias("b")).select("page_id", *[F.col(f"b.{c}").alias(c) for c in ("box_idx", *G.EDGES, "confidence", *extra)])


def suppressed(bs: Column, threshold: float = NMS_IOU) -> Column:
    """Greedy non-maximum suppression of an array of boxes, the best first."""
    empty = F.filter(bs, lambda x: F.lit(False))
    return F.aggregate(bs, empty, lambda acc, x: F.when(F.exists(acc, lambda k: G.iou(k, x) >= threshold), acc).otherwise(F.concat(acc, F.array(x))))


def without_outer(bs: Column) -> Column:
    """Boxes of an array that contain no other of it."""
    return let(bs, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (x["box_idx"] != y["box_idx"]) & G.contains(x, y))))


def suppress(boxes: DataFrame, threshold: float = NMS_IOU, extra: tuple[str, ...] = ()) -> DataFrame:
    """Greedy non-maximum suppression: by confidence, a box stays if it overlaps every kept one by less than the threshold."""
    pages = as_pages(boxes, -F.col("confidence"), F.col("box_idx"), extra=extra)
    return from_pages(pages.select("page_id", suppressed(F.col("bs"), threshold).alias("bs")), extra)


def innermost(boxes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Boxes that contain no other box of the page; two equal boxes remove each other."""
    pages = as_pages(boxes, F.col("box_idx"), extra=extra)
    return from_pages(pages.select("page_id", without_outer(F.col("bs")).alias("bs")), extra)


def reading_order(boxes: DataFrame) -> DataFrame:
    """read_idx from 0: right to left by min_x, then down by min_y, then by confidence."""
    w = W.partitionBy("page_id").orderBy(F.desc("min_x"), "min_y", F.desc("confidence"), "box_idx")
    return boxes.withColumn("read_idx", (F.row_number().over(w) - 1).cast("int"))


def postprocess(raw: DataFrame) -> DataFrame:
    """Decoded boxes after suppression, without outer ones, with read_idx: one array a page from end to end."""
    pages = as_pages(decode_yolo(raw), -F.col("confidence"), F.col("box_idx"))
    fields = ("box_idx", *G.EDGES, "confidence")
    keyed = lambda x: F.struct((-x["min_x"]).alias("x"), x["min_y"].alias("y"), (-x["confidence"]).alias("c"), *[x[f].alias(f) for f in fields])
    ordered = F.sort_array(F.transform(without_outer(suppressed(F.col("bs"))), keyed))
    return pages.select("page_id", F.posexplode(ordered).alias("read_idx", "b")).select("page_id", *[F.col(f"b.{f}").alias(f) for f in fields], "read_idx")


def box_pairs(boxes: DataFrame) -> DataFrame:
    """(page_id, a, b): boxes of one page, each pair once, from the page's own array."""
    pages = as_pages(boxes, F.col("box_idx"))
    both = pages.select("page_id", "bs", F.explode("bs").alias("a"))
    return both.select("page_id", "a", F.explode(F.filter("bs", lambda y: y["box_idx"] > F.col("a")["box_idx"])).alias("b"))


def page_groups(boxes: DataFrame, reach: float = 80.0, overlap: float = 0.5, extra: tuple[str, ...] = ()) -> DataFrame:
    """page_id and gs: the page's transitive groups of near boxes, each an array."""
    pages = as_pages(boxes, F.col("box_idx"), extra=extra)
    empty = F.expr("filter(transform(bs, x -> array(x)), x -> false)")

    def add(acc, x):
        joins = lambda g: F.exists(g, lambda m: G.near(m, x, reach, overlap))
        met = F.flatten(F.filter(acc, joins))
        return F.concat(F.filter(acc, lambda g: ~joins(g)), F.array(F.concat(met, F.array(x))))

    return pages.select("page_id", F.aggregate("bs", empty, add).alias("gs"))


def group_numbers(boxes: DataFrame, reach: float = 80.0, overlap: float = 0.5) -> DataFrame:
    """(page_id, box_idx, group_id): transitive groups of near boxes; a group is named by its smallest index."""
    groups = page_groups(boxes, reach, overlap).select("page_id", F.explode("gs").alias("g"))
    return groups.select("page_id", F.array_min(F.transform("g", lambda m: m["box_idx"])).alias("group_id"), F.explode("g").alias("m")).select("page_id", F.col("m.box_idx").alias("box_idx"), "group_id")


def merge_groups(boxes: DataFrame, text_col: str = "text") -> DataFrame:
    """A row a group: bounds, mean confidence, text in reading order of centres, members, and the group's place in that order."""
    of = lambda g, f: F.transform(g, lambda m: m[f])
    known = lambda g: F.filter(of(g, "confidence"), lambda v: v.isNotNull())

    def member(m):
        return F.struct((-(m["min_x"] + m["max_x"]) / 2).alias("x"), ((m["min_y"] + m["max_y"]) / 2).alias("y"), m["box_idx"].alias("i"), m[text_col].alias("t"))

    def merged(g):
        text = F.array_join(F.transform(F.sort_array(F.transform(g, member)), lambda m: m["t"]), "")
        confidence = F.aggregate(known(g), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(known(g)), F.lit(0))
        return F.struct(F.array_min(of(g, "box_idx")).alias("group_id"), *[(F.array_min if e.startswith("min") else F.array_max)(of(g, e)).alias(e) for e in G.EDGES], confidence.alias("confidence"), text.alias("text"), F.size(g).alias("members"))

    fields = ("group_id", *G.EDGES, "confidence", "text", "members")
    keyed = lambda b: F.struct((-(b["min_x"] + b["max_x"])).alias("x"), (b["min_y"] + b["max_y"]).alias("y"), b["group_id"].alias("g"), b.alias("b"))
    ordered = F.sort_array(F.transform(F.transform("gs", merged), keyed))
    rows = page_groups(boxes, extra=(text_col,)).select("page_id", F.posexplode(ordered).alias("group_pos", "r"))
    return rows.select("page_id", *[F.col(f"r.b.{f}").alias(f) for f in fields], "group_pos")


def derive_blocks(lines: DataFrame) -> DataFrame:
    """Blocks from text lines: lines closer than MERGE_REACH become their common bounds, until none are; confidence 0.9.

    Bounds only grow, so the end does not depend on the order, and a page's lines are added one at a time: each takes in
    what it reaches, again and again, at most as often as there are blocks.
    """
    pages = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*G.EDGES))).alias("bs"))

    def reaches(a, b):
        r = MERGE_REACH
        return (a["min_x"] - r <= b["max_x"]) & (a["max_x"] + r >= b["min_x"]) & (a["min_y"] - r <= b["max_y"]) & (a["max_y"] + r >= b["min_y"])

    def bounds(now, hits):
        low = lambda e: F.least(now[e], F.coalesce(F.array_min(F.transform(hits, lambda h: h[e])), now[e])).alias(e)
        top = lambda e: F.greatest(now[e], F.coalesce(F.array_max(F.transform(hits, lambda h: h[e])), now[e])).alias(e)
        return F.struct(low("min_x"), low("min_y"), top("max_x"), top("max_y"))

    def absorb(s, _):
        hits = F.filter(s["rest"], lambda b: reaches(s["now"], b))
        return F.struct(bounds(s["now"], hits).alias("now"), F.filter(s["rest"], lambda b: ~reaches(s["now"], b)).alias("rest"))

    def add(acc, x):
        done = F.aggregate(F.sequence(F.lit(0), F.size(acc)), F.struct(x.alias("now"), acc.alias("rest")), absorb)
        return let(done, lambda d: F.concat(d["rest"], F.array(d["now"])))

    found = pages.select("page_id", F.explode(F.aggregate("bs", F.expr("filter(bs, x -> false)"), add)).alias("b"))
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return spread(found).where(area >= MIN_BLOCK_AREA).withColumn("confidence", F.lit(0.9))


def lines_to_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """For each block the lines whose centre it holds, a line in its first block only; blocks without lines stay with an empty list."""
    x, y = (F.col("l.min_x") + F.col("l.max_x")) / 2, (F.col("l.min_y") + F.col("l.max_y")) / 2
    held = lines.alias("l").join(blocks.alias("b"), (F.col("l.page_id") == F.col("b.page_id")) & (x >= F.col("b.min_x")) & (x <= F.col("b.max_x")) & (y >= F.col("b.min_y")) & (y <= F.col("b.max_y")))
    first = held.groupBy(F.col("l.page_id").alias("page_id"), F.col("l.box_idx").alias("line_idx")).agg(F.min("b.box_idx").alias("box_idx"))
    lists = first.groupBy("page_id", "box_idx").agg(F.sort_array(F.collect_list("line_idx")).alias("lines"))
    return blocks.join(lists, ["page_id", "box_idx"], "left").select("page_id", "box_idx", F.coalesce("lines", F.expr("cast(array() as array<int>)")).alias("lines"))
