"""Column functions on images as arrays: row-major, channels last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import let


def channels_first(px: Column, pixels: Column, channels: Column, bgr: bool = False) -> Column:
    """Red, green and blue planes in 0..1 of 0..255 values; null for other than 1, 3 or 4 channels or too few values.

    One channel is grey, which fills all planes; the fourth is dropped; bgr says that blue comes first.
    """
    plane = lambda k: F.floor(k / pixels).cast("int")
    first = lambda k: (F.lit(2) - plane(k)) if bgr else plane(k)
    known = channels.isin(1, 3, 4) & (F.size(px) >= pixels * channels) & (pixels > 0)
    at = lambda k: (k % pixels) * channels + F.when(channels == 1, F.lit(0)).otherwise(first(k))
    return F.when(known, let(px, lambda p: F.transform(F.sequence(F.lit(0), pixels * 3 - 1), lambda k: F.get(p, at(k).cast("int")).cast("double") / 255)))


def text_mask(values: Column, stride: Column, padded_w: Column, padded_h: Column, width: Column, height: Column, threshold: float = 0.3) -> Column:
    """255 where a map of a padded image, cut to its content and resized to the image's size, exceeds the threshold, else 0.

    Bilinear, with pixels' centres aligned and edges repeated. Null without content or size.
    """

    def ends(i: Column, size: Column, content: Column):
        at = F.greatest(F.lit(0.0), (i + F.lit(0.5)) * content / size - F.lit(0.5))
        low = F.least(F.floor(at), content - 1)
        return low, F.least(low + 1, content - 1), F.least(at - low, F.lit(1.0))

    def one(p: Column, k: Column) -> Column:
        x0, x1, fx = ends(k % width, width, padded_w)
        y0, y1, fy = ends(F.floor(k / width), height, padded_h)
        v = lambda x, y: F.get(p, (y * stride + x).cast("int")).cast("double")
        top = v(x0, y0) * (F.lit(1.0) - fx) + v(x1, y0) * fx
        low = v(x0, y1) * (F.lit(1.0) - fx) + v(x1, y1) * fx
        return F.when(top * (F.lit(1.0) - fy) + low * fy > threshold, 255).otherwise(0)

    some = (padded_w > 0) & (padded_h > 0) & (width > 0) & (height > 0)
    return F.when(some, let(values, lambda p: F.transform(F.sequence(F.lit(0), width * height - 1), lambda k: one(p, k))))
