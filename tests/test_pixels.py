"""Pixel operators against slow versions and shapes worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from glyphflow.functions import pixels as X
from glyphflow.operators import pixels as P


def slow_window(mask, sides, every):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y in range(h):
        for x in range(w):
            seen = [mask[b, a] for b in range(y - sides[1] // 2, y - sides[1] // 2 + sides[1]) for a in range(x - sides[0] // 2, x - sides[0] // 2 + sides[0]) if 0 <= a < w and 0 <= b < h]
            out[y, x] = all(seen) if every else any(seen)
    return out


def test_windows():
    rng = np.random.default_rng(1)
    for sides in ((2, 2), (3, 12), (12, 3)):
        for every in (False, True):
            mask = rng.random((17, 23)) < (0.9 if every else 0.05)
            assert (P.windowed(mask, sides, every) == slow_window(mask, sides, every)).all()


def test_split_level_has_the_largest_variance_between_sides():
    rng = np.random.default_rng(2)
    for _ in range(20):
        grey = np.concatenate([rng.integers(0, 90, 60), rng.integers(120, 256, 40)])

        def between(t):
            a, b = grey[grey <= t], grey[grey > t]
            return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0

        best = max(range(256), key=lambda t: round(between(t), 6))
        assert between(P.split_level(grey)) == between(best)
    assert P.split_level(np.full(9, 7)) == 0


def slow_parts(mask, diagonal):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            b, a = todo.pop()
            if 0 <= b < mask.shape[0] and 0 <= a < mask.shape[1] and mask[b, a] and not out[b, a]:
                out[b, a] = n
                todo += [(b + j, a + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    return out


def test_parts():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.2, 0.45, 0.6, 0.9, 1.0):
        for diagonal in (False, True):
            mask = rng.random((15, 19)) < share
            assert (P.labelled(mask, diagonal) == slow_parts(mask, diagonal)).all()


def test_lines_by_hand():
    m = np.zeros((20, 30))
    m[2:8, 3:13] = 0.9  # 10 x 6: outline of 9 x 5
    m[4, 5] = 0.1  # a hole
    m[12:15, 20:23] = 0.9  # 3 x 3: 2 x 2
    m[10, 1:25] = 0.31  # a line has no area
    m[18:, :] = 1.0  # beyond the content
    assert P.text_lines(m, (30, 16), (60, 32), 0.5, least=16) == [(6, 4, 26, 16, 180), (40, 24, 46, 30, 16)]
    assert P.text_lines(m, (30, 16), (60, 32), 0.5) == [(6, 4, 26, 16, 180)]
    ring = np.zeros((9, 9))
    ring[0:9, 0:9] = 1
    ring[2:7, 2:7] = 0
    ring[4, 4] = 1  # inside the hole of another part
    assert P.text_lines(ring, (9, 9), (9, 9), 1.0, least=1) == [(0, 0, 9, 9, 64)]
    corner = np.zeros((4, 4))
    corner[0, 0] = corner[0, 1] = corner[1, 0] = 1
    assert P.text_lines(corner, (4, 4), (4, 4), 1.0, least=0.5) == [(0, 0, 2, 2, 0)]
    assert P.text_lines(np.zeros((3, 3)), (3, 3), (3, 3), 1.0) == []


def test_bounds_by_hand():
    px = np.full((40, 60), 250.0)
    px[10:14, 20:24] = 5
    px[30, 50] = 0  # a speck goes
    # opening moves the block's 3 x 3 core back to 4 x 4, one pixel right and down; then rows of 2 x (12, 3), less (2, 2)
    box = np.zeros((40, 60), bool)
    box[10:14, 20:24] = True
    box = slow_window(slow_window(box, (2, 2), True), (2, 2), False)
    for _ in range(2):
        box = slow_window(box, (12, 3), False)
    box = slow_window(box, (2, 2), True)
    ys, xs = np.nonzero(box)
    assert P.text_bounds(px) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
    assert P.text_bounds(np.full((10, 10), 9.0)) is None  # all is text: more than 95 %
    coloured = np.repeat(px[:, :, None], 3, axis=2)
    assert P.text_bounds(coloured) == P.text_bounds(px)


def test_columns(spark):
    grey = [255] * 100
    rows = [(1, grey, 10), (2, None, 10), (3, [], 10)]
    df = spark.createDataFrame(rows, "i int, px array<int>, n int")
    got = df.select("i", P.morphological_bounds(F.col("px"), F.col("n"), F.col("n"), F.lit(1)).alias("b"), P.map_lines(F.col("px"), F.col("n"), F.col("n"), F.col("n"), F.col("n"), F.col("n"), F.lit(1.0), least=1).alias("l"))
    found = {r.i: (r.b.min_x, [tuple(x) for x in r.l]) for r in got.collect()}
    assert found == {1: (None, [(0, 0, 10, 10, 81)]), 2: (None, []), 3: (None, [])}


def test_planes_and_masks(spark):
    df = spark.createDataFrame([(1, [10, 20, 30, 40], 1), (2, [1, 2, 3, 4, 5, 6], 3), (3, [1, 2, 3, 9, 4, 5, 6, 9], 4), (4, [1, 2], 2), (5, [1], 3), (6, None, 3)], "i int, px array<int>, c int")
    n = F.when(F.col("i") == 1, 4).otherwise(2)
    rgb = {r.i: r.x and [round(v * 255) for v in r.x] for r in df.select("i", X.channels_first(F.col("px"), n, F.col("c")).alias("x")).collect()}
    assert rgb == {1: [10, 20, 30, 40] * 3, 2: [1, 4, 2, 5, 3, 6], 3: [1, 4, 2, 5, 3, 6], 4: None, 5: None, 6: None}
    bgr = {r.i: [round(v * 255) for v in r.x] for r in df.where("i in (2, 3)").select("i", X.channels_first(F.col("px"), n, F.col("c"), bgr=True).alias("x")).collect()}
    assert bgr == {2: [3, 6, 2, 5, 1, 4], 3: [3, 6, 2, 5, 1, 4]}
    m = spark.createDataFrame([([0.0, 1.0, 9.0, 0.0, 1.0, 9.0],)], "v array<double>")
    same = m.select(X.text_mask(F.col("v"), F.lit(3), F.lit(2), F.lit(2), F.lit(2), F.lit(2)).alias("m")).first().m
    wide = m.select(X.text_mask(F.col("v"), F.lit(3), F.lit(2), F.lit(2), F.lit(4), F.lit(1)).alias("m")).first().m
    assert same == [0, 255, 0, 255] and wide == [0, 0, 255, 255]  # 0, 0.25, 0.75, 1
