"""Registered queries on pixels, with SQL twins where SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import pixels as X
from ..operators import pixels as P
from .fixtures import view

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_GREY = "list_transform(embedding, lambda v: least(255.0, greatest(0.0, 128.0 + 400.0 * CAST(v AS DOUBLE))))"
_CHANNEL = "CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 END"


@query(f"""WITH g AS (SELECT vec_id, {_GREY} AS px, CAST({_CHANNEL} AS INT) AS c FROM embeddings)
 SELECT vec_id, k::INT AS k, round(px[1 + (k % 16) * c + CASE WHEN c = 1 THEN 0 ELSE 2 - k // 16 END] / 255, 9) AS value FROM g, range(48) t(k) WHERE c <> 2""")
def channel_planes(spark, sf):
    """Patches read as images of 4 x 4 pixels with one, three or four channels, blue first; two channels are none."""
    p = view(spark, sf, "patches").select("vec_id", X.channels_first(L.grey(F.col("px")), F.lit(16), F.expr(f"cast({_CHANNEL} as int)"), bgr=True).alias("x"))
    return p.select("vec_id", F.posexplode("x").alias("k", "value")).select("vec_id", "k", F.round("value", 9).alias("value"))


_ENDS = "greatest(0.0::DOUBLE, ({i} + 0.5::DOUBLE) * {c}::DOUBLE / {s}::DOUBLE - 0.5::DOUBLE)"


@query(f"""WITH g AS (SELECT vec_id, list_transform({_GREY}, lambda v: v / 255.0) AS px FROM embeddings), k AS (SELECT vec_id, px, k, {_ENDS.format(i='(k % 12)', c=7, s=12)} AS x, {_ENDS.format(i='(k // 12)', c=6, s=10)} AS y FROM g, range(120) t(k)),
 f AS (SELECT vec_id, k, px, least(floor(x), 6)::INT AS x0, least(floor(y), 5)::INT AS y0, least(x - least(floor(x), 6), 1) AS fx, least(y - least(floor(y), 5), 1) AS fy FROM k),
 e AS (SELECT *, least(x0 + 1, 6) AS x1, least(y0 + 1, 5) AS y1 FROM f)
 SELECT vec_id, count(*) FILTER (WHERE (px[1 + y0 * 8 + x0] * (1 - fx) + px[1 + y0 * 8 + x1] * fx) * (1 - fy) + (px[1 + y1 * 8 + x0] * (1 - fx) + px[1 + y1 * 8 + x1] * fx) * fy > 0.3) AS n_text, count(*) AS n FROM e GROUP BY vec_id""")
def text_masks(spark, sf):
    """Patches read as maps of 8 x 8, of which 7 x 6 are content, for images of 12 x 10."""
    unit = F.transform(L.grey(F.col("px")), lambda v: v / 255.0)
    m = view(spark, sf, "patches").select("vec_id", X.text_mask(unit, F.lit(8), F.lit(7), F.lit(6), F.lit(12), F.lit(10)).alias("m"))
    return m.select("vec_id", F.size(F.filter("m", lambda v: v == 255)).cast("long").alias("n_text"), F.size("m").cast("long").alias("n"))


@query()
def morph_bounds(spark, sf):
    """Patches on a white ground of 40 x 40: where the text is."""
    on, levels = (F.col("vec_id") % 30).cast("int"), F.transform(L.grey(F.col("px")), lambda v: F.floor(v).cast("int"))
    white = lambda n: F.array_repeat(F.lit(255), n)
    ground = F.concat(white(400), *[F.concat(white(on), F.slice(levels, 8 * i + 1, 8), white(32 - on)) for i in range(8)], white(880))
    b = view(spark, sf, "patches").select("vec_id", P.morphological_bounds(ground, F.lit(40), F.lit(40), F.lit(1)).alias("b"))
    return b.select("vec_id", "b.min_x", "b.min_y", "b.max_x", "b.max_y")


@query()
def map_lines(spark, sf):
    """Patches read as maps of 8 x 8 whose image is sixteen times as large."""
    unit = F.transform(L.grey(F.col("px")), lambda v: v / 255.0)
    lines = P.map_lines(unit, F.lit(8), F.lit(8), F.lit(7), F.lit(128), F.lit(112), F.lit(1 / 16), threshold=0.5)
    return view(spark, sf, "patches").select("vec_id", F.posexplode(lines).alias("line", "b")).select("vec_id", "line", "b.*")
