"""Column functions on axis-aligned boxes; a box is a struct, or columns, named min_x, min_y, max_x, max_y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("min_x", "min_y", "max_x", "max_y")


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{e}").alias(e) for e in EDGES])


def edges(b: Column) -> list[Column]:
    return [b[e] for e in EDGES]


def area(b: Column) -> Column:
    return (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where no area overlaps."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    inner = (w * h).cast("double")
    union = area(a) + area(b) - inner
    return F.when((w > 0) & (h > 0) & (union > 0), inner / union).otherwise(F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    """Inclusive on all sides."""
    return (outer["min_x"] <= inner["min_x"]) & (outer["min_y"] <= inner["min_y"]) & (outer["max_x"] >= inner["max_x"]) & (outer["max_y"] >= inner["max_y"])


def gap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return F.greatest(b_min - a_max, a_min - b_max, F.lit(0))


def distance(a: Column, b: Column) -> Column:
    """Between the nearest edges; 0 where the boxes touch or overlap."""
    dx, dy = gap(a["min_x"], a["max_x"], b["min_x"], b["max_x"]), gap(a["min_y"], a["max_y"], b["min_y"], b["max_y"])
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def y_overlap(a: Column, b: Column) -> Column:
    """Shared height over the smaller height; 0 where that is 0."""
    shared = F.greatest(F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"]), F.lit(0))
    smaller = F.least(a["max_y"] - a["min_y"], b["max_y"] - b["min_y"])
    return F.when(smaller == 0, F.lit(0.0)).otherwise(shared / smaller)


def near(a: Column, b: Column, reach: float = 80.0, overlap: float = 0.5) -> Column:
    """The boxes belong to one group: they touch, or they are close and share height."""
    d = distance(a, b)
    return (d == 0) | ((d <= reach) & (y_overlap(a, b) >= overlap))


def crop(b: Column, width: Column, height: Column, padding: int = 5) -> Column:
    """The box with padding, within the image."""
    return F.struct(F.greatest(F.lit(0), b["min_x"] - padding).alias("min_x"), F.greatest(F.lit(0), b["min_y"] - padding).alias("min_y"), F.least(width, b["max_x"] + padding).alias("max_x"), F.least(height, b["max_y"] + padding).alias("max_y"))


def inset(b: Column, percent: int = 1) -> Column:
    """Each side moved in by that percentage of the extent, rounded down."""
    dx = F.floor((b["max_x"] - b["min_x"]) * percent / 100).cast("int")
    dy = F.floor((b["max_y"] - b["min_y"]) * percent / 100).cast("int")
    return F.struct((b["min_x"] + dx).alias("min_x"), (b["min_y"] + dy).alias("min_y"), (b["max_x"] - dx).alias("max_x"), (b["max_y"] - dy).alias("max_y"))


def clip_int(x: Column, top: Column) -> Column:
    """Within 0 and top, then truncated."""
    return F.least(F.greatest(x, F.lit(0.0)), top.cast("double")).cast("int")


def decode_center(cx: Column, cy: Column, bw: Column, bh: Column, scale: Column, width: Column, height: Column) -> Column:
    """A centre-format box in image pixels."""
    return F.struct(clip_int((cx - bw / 2) / scale, width).alias("min_x"), clip_int((cy - bh / 2) / scale, height).alias("min_y"), clip_int((cx + bw / 2) / scale, width).alias("max_x"), clip_int((cy + bh / 2) / scale, height).alias("max_y"))


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def floor_div(a: Column, b: Column) -> Column:
    """Floor division of non-negative doubles that agrees with exact remainders (a plain floor of a / b does not always)."""
    return F.round((a - a % b) / b)
