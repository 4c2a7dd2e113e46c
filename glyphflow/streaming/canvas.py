"""Change detection on canvas frames: a batch form, and a stream that keeps each canvas's last frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import files

SCHEMA = "event_id long, canvas_id long, px_sum long"


def changes(frames: DataFrame, slice_s: int = 3600, before: DataFrame | None = None) -> DataFrame:
    """Frames that differ from the one before of the same canvas; a canvas's first frame is none.

    A canvas's time is cut into slices, so that a hot one is many tasks; a slice's first frame is compared with the last of the
    slice before it. `before` (canvas_id, px_sum) holds the frames that came before all these, one a canvas.
    """
    cut = frames.select("event_id", "canvas_id", "px_sum", "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(slice_s * 1_000_000)).alias("_s"))
    own = F.struct("px_sum")
    ends = cut.groupBy("canvas_id", "_s").agg(F.max_by(own, F.struct("ts", "event_id")).alias("end"))
    told = ends.withColumn("told", F.lag("end").over(W.partitionBy("canvas_id").orderBy(F.asc_nulls_first("_s")))).drop("end")
    if before is not None:
        old = before.select(F.col("canvas_id").alias("_c"), F.struct("px_sum").alias("old"))
        told = told.join(old, F.col("canvas_id").eqNullSafe(F.col("_c")), "left").withColumn("told", F.coalesce("told", "old")).drop("_c", "old")
    told = told.select(F.col("canvas_id").alias("_c"), F.col("_s").alias("_t"), "told")
    rows = cut.withColumn("last", F.lag(own).over(W.partitionBy("canvas_id", "_s").orderBy("ts", "event_id")))
    rows = rows.join(told, F.col("canvas_id").eqNullSafe(F.col("_c")) & F.col("_s").eqNullSafe(F.col("_t")), "left")
    return rows.where(F.col("px_sum") != F.coalesce("last", "told")["px_sum"]).select("event_id", "canvas_id", "px_sum")


def change_steps(spark: SparkSession, where: str):
    """A step for foreachBatch that appends each batch's changes below `where`/rows and keeps each canvas's last frame.

    Batches follow time. Both tables of a batch are named by its number, so a repeated batch replaces what it had written.
    No Python runs, and a hot canvas is sorted in slices.
    """

    def step(batch: DataFrame, n: int) -> None:
        old = files.first_existing(spark, [f"{where}/last/{n - 1}"])
        before = spark.read.parquet(old) if old else None
        changes(batch, before=before).write.mode("overwrite").parquet(f"{where}/rows/batch={n}")
        last = batch.groupBy("canvas_id").agg(F.max_by(F.struct("px_sum"), F.struct("ts", "event_id")).alias("f")).select("canvas_id", "f.px_sum")
        if before is not None:
            last = last.unionByName(before.join(last.select(F.col("canvas_id").alias("_c")), F.col("canvas_id").eqNullSafe(F.col("_c")), "left_anti"))
        last.write.mode("overwrite").parquet(f"{where}/last/{n}")

    return step


def _stepper(forget_ms):
    def step(key, parts, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        out = []
        for event, px in zip(rows["event_id"], rows["px_sum"]):
            if last is not None and px != last:
                out.append((event, key[0], px))
            last = int(px)
        state.update((last,))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["event_id", "canvas_id", "px_sum"])

    return step


def change_stream(frames: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The same as one stateful operator, for few frames a canvas and batch; batches follow time. A canvas unseen for forget_ms is forgotten (null: none is).

    With forget_ms Spark keeps starting batches without rows, so it is for streams that run on, not for drained ones.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return frames.groupBy("canvas_id").applyInPandasWithState(_stepper(forget_ms), SCHEMA, "last long", "append", timeout)
