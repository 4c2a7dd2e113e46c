"""Text bounds and text lines from pixels: morphology and outlines, which column expressions can't follow, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .session import LEAST_SHARE, MOST_SHARE

#: Weights of red, green and blue in grey; the least value of a map that is text; the least area of a line.
GREY, TEXT, MIN_AREA = (0.299, 0.587, 0.114), 0.3, 100
#: Sides of the windows (width, height) that join the characters of columns and of rows, applied twice.
COLUMNS, ROWS, OPEN = (3, 12), (12, 3), (2, 2)
_BOUNDS = "min_x int, min_y int, max_x int, max_y int"


def grey_levels(px: np.ndarray) -> np.ndarray:
    """Whole levels of an image of one, three (red first) or four channels."""
    if px.ndim == 2:
        return px.astype(np.int64)
    if px.shape[2] == 1:
        return px[:, :, 0].astype(np.int64)
    return np.floor(px[:, :, :3] @ np.array(GREY) + 0.5).astype(np.int64)


def split_level(grey: np.ndarray) -> int:
    """Otsu's threshold: the level that parts the greys with the largest variance between both sides, the first of equals."""
    share = np.bincount(grey.ravel(), minlength=256)[:256] / grey.size
    below = np.cumsum(share)
    mass = np.cumsum(share * np.arange(256))
    both = np.minimum(below, 1 - below) > np.finfo(np.float32).eps
    if not both.any():
        return 0
    between = np.zeros(256)
    between[both] = (mass[-1] * below[both] - mass[both]) ** 2 / (below[both] * (1 - below[both]))
    return int(np.argmax(between.round(9)))


def windowed(mask: np.ndarray, sides: tuple[int, int], every: bool = False) -> np.ndarray:
    """Whether any (or every) pixel of the window around each pixel is set; pixels outside the image don't count."""
    for axis, side in ((1, sides[0]), (0, sides[1])):
        at = np.arange(mask.shape[axis])
        low, top = np.maximum(at - side // 2, 0), np.minimum(at - side // 2 + side, len(at))
        pad = [(0, 0), (0, 0)]
        pad[axis] = (1, 0)
        total = np.pad(np.cumsum(mask, axis=axis), pad)
        n = np.take(total, top, axis=axis) - np.take(total, low, axis=axis)
        mask = n == ((top - low)[None, :] if axis == 1 else (top - low)[:, None]) if every else n > 0
    return mask


def text_bounds(px: np.ndarray) -> tuple[int, int, int, int] | None:
    """Bounds of dark text on a lighter ground, characters joined along the reading direction; None for too little or too much."""
    grey = grey_levels(px)
    text = windowed(windowed(grey <= split_level(grey), OPEN, every=True), OPEN)
    vertical = np.var(text.sum(axis=0)) > np.var(text.sum(axis=1)) * 1.3
    for _ in range(2):
        text = windowed(text, COLUMNS if vertical else ROWS)
    text = windowed(text, OPEN, every=True)
    if not text.any():
        return None
    xs, ys = np.flatnonzero(text.any(axis=0)), np.flatnonzero(text.any(axis=1))
    x0, x1, y0, y1 = int(xs[0]), int(xs[-1]) + 1, int(ys[0]), int(ys[-1]) + 1
    share = (x1 - x0) * (y1 - y0)
    return (x0, y0, x1, y1) if LEAST_SHARE * text.size <= share <= MOST_SHARE * text.size else None


def labelled(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """0 where the mask is not set, else the number of the connected part, from 1 by the parts' first pixels.

    Rows are runs, and runs that touch the row before join its parts.
    """
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if diagonal else 0
    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    s, e = starts.tolist(), ends.tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if s[j] < e[i] + reach and s[i] < e[j] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(parent))], dtype=np.int64)
    names = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    flat = np.zeros(mask.size + 1, dtype=np.int64)
    width = mask.shape[1]
    np.add.at(flat, rows * width + starts, names)
    np.add.at(flat, rows * width + ends, -names)
    return np.cumsum(flat)[:-1].reshape(mask.shape)


def text_lines(values: np.ndarray, padded: tuple[int, int], size: tuple[int, int], scale: float, threshold: float = TEXT, least: float = MIN_AREA) -> list[tuple[int, int, int, int, int]]:
    """Bounds and areas, in the image's pixels, of the outermost parts of a map (cut to `padded`) over the threshold.

    An area is that of the outline through the centres of a part's outer pixels, so holes count and lines have none. Lists
    by the parts' first pixels.
    """
    mask = values[: padded[1], : padded[0]] > threshold
    if not mask.any():
        return []
    ground = labelled(~np.pad(mask, 1), diagonal=False)
    filled = (ground != 1)[1:-1, 1:-1]  # the outer ground holds the corner
    parts = labelled(filled, diagonal=True)
    n = int(parts.max())
    square = np.stack([parts[:-1, :-1], parts[:-1, 1:], parts[1:, :-1], parts[1:, 1:]])
    whole = (square > 0).sum(axis=0)
    areas = np.bincount(square.max(axis=0).ravel(), weights=np.where(whole == 4, 1.0, np.where(whole == 3, 0.5, 0.0)).ravel(), minlength=n + 1)
    ys, xs = np.nonzero(parts)
    at = parts[ys, xs]
    low, top = np.full((2, n + 1), 1 << 40), np.full((2, n + 1), -1)
    for k, v in enumerate((xs, ys)):
        np.minimum.at(low[k], at, v)
        np.maximum.at(top[k], at, v)
    out = []
    for p in range(1, n + 1):
        area = areas[p] / (scale * scale)
        b = [int(max(0, min(v / scale, side))) for v, side in zip((low[0][p], low[1][p], top[0][p] + 1, top[1][p] + 1), (*size, *size))]
        if area >= least and b[2] > b[0] and b[3] > b[1]:
            out.append((*b, int(area)))
    return out


def _image(px, height, width, channels):
    return np.asarray(px, dtype=np.float64).reshape((height, width) if channels == 1 else (height, width, channels))


def morphological_bounds(px: Column, height: Column, width: Column, channels: Column) -> Column:
    """{min_x, min_y, max_x, max_y} of the text in a crop of 0..255 values; null edges where there is none, and for no pixels."""

    @F.pandas_udf(_BOUNDS)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            found = [None if p is None or not len(p) else text_bounds(_image(p, int(h), int(w), int(c))) for p, h, w, c in zip(*columns)]
            yield pd.DataFrame([f or (None,) * 4 for f in found], columns=["min_x", "min_y", "max_x", "max_y"], dtype="Int32")

    return run.asNondeterministic()(px, height, width, channels)  # so that it isn't called once for each edge


def map_lines(values: Column, stride: Column, padded_w: Column, padded_h: Column, width: Column, height: Column, scale: Column, threshold: float = TEXT, least: float = MIN_AREA) -> Column:
    """An array of {min_x, min_y, max_x, max_y, area}: the text lines of a probability map; none for a null map."""
    names = ("min_x", "min_y", "max_x", "max_y", "area")

    @F.pandas_udf(f"array<struct<{', '.join(f'{x}: int' for x in names)}>>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out = []
            for p, line, pw, ph, w, h, s in zip(*columns):
                rows = [] if p is None or not len(p) else text_lines(np.asarray(p, dtype=np.float64).reshape(-1, int(line)), (int(pw), int(ph)), (int(w), int(h)), float(s), threshold, least)
                out.append([dict(zip(names, r)) for r in rows])
            yield pd.Series(out)

    return run.asNondeterministic()(values, stride, padded_w, padded_h, width, height, scale)
