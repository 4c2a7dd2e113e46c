"""Assembly of page results: nested responses, timings, ordinal joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def polygon_bounds(points: Column, width: int, height: int) -> Column:
    """Bounds of [x, y] points, within 0 and size - 1."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    fit = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top - 1))
    return F.struct(fit(F.array_min(xs), width).alias("min_x"), fit(F.array_min(ys), height).alias("min_y"), fit(F.array_max(xs), width).alias("max_x"), fit(F.array_max(ys), height).alias("max_y"))


def respond(images: DataFrame, boxes: DataFrame, fields: list[str]) -> DataFrame:
    """request_id and a JSON text: a list for each image in order, with its boxes in order; images without boxes give [].

    images: request_id, image_idx. boxes: both, box_pos and the fields.
    """
    lists = boxes.groupBy("request_id", "image_idx").agg(F.sort_array(F.collect_list(F.struct("box_pos", F.struct(*fields).alias("b")))).alias("bs"))
    whole = images.join(lists, ["request_id", "image_idx"], "left").select("request_id", "image_idx", F.transform(F.coalesce("bs", F.expr("array()")), lambda x: x["b"]).alias("bs"))
    return whole.groupBy("request_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("image_idx", "bs"))), lambda x: x["bs"])).alias("response"))


def even_timing(rows: DataFrame, key: str, total_ms: Column) -> Column:
    """A batch's time, dealt evenly to its rows."""
    return total_ms / F.count("*").over(W.partitionBy(key))


def by_position(left: DataFrame, right: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """All rows of the left side, with the right side's value at the same place or the default."""
    return left.join(right, keys, "left").withColumn(value, F.coalesce(F.col(value), default))


def zip_shortest(*arrays: Column) -> Column:
    """Parallel arrays as one array of structs, cut to the shortest."""
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), F.lit(1), n)
