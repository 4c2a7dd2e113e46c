"""Registered streaming queries: each drains its table as a stream and returns what reached the sink."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..streaming import canvas, runs
from .fixtures import with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FRAMES = with_views("canvas_frames")


@query(f"{_FRAMES}, w AS (SELECT event_id, canvas_id, px_sum, lag(px_sum) OVER (PARTITION BY canvas_id ORDER BY ts, event_id) AS last FROM canvas_frames) SELECT event_id, canvas_id, px_sum FROM w WHERE last IS NOT NULL AND px_sum <> last")
def canvas_change_stream(spark, sf):
    events = runs.table_stream(spark, f"{sf}/events.parquet")
    frames = events.selectExpr("event_id", "user_id as canvas_id", "ts", "cast(floor(value) as bigint) % 7 as px_sum")
    return runs.drained(spark, frames, canvas.SCHEMA, step=lambda out: canvas.change_steps(spark, out))


@query(SQL["canvas_change_stream"])
def canvas_polled(spark, sf):
    """The same with one stateful operator, whose batches start every second."""
    events = runs.table_stream(spark, f"{sf}/events.parquet")
    frames = events.selectExpr("event_id", "user_id as canvas_id", "ts", "cast(floor(value) as bigint) % 7 as px_sum")
    return runs.drained(spark, canvas.change_stream(frames), canvas.SCHEMA, interval="1 second")


@query("SELECT conv_id, turn, role, md5(text) AS key, CAST(length(text) AS BIGINT) AS chars, length(text) > 0 AS success FROM conversations")
def stream_pipeline(spark, sf):
    rows = runs.table_stream(spark, f"{sf}/conversations.parquet")
    done = rows.select("conv_id", "turn", "role", F.md5("text").alias("key"), F.length("text").cast("long").alias("chars"), (F.length("text") > 0).alias("success"))
    return runs.drained(spark, done, done.schema)


@query("SELECT CAST(doc_id % 6 AS INT) AS worker, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def queue_drain(spark, sf):
    rows = runs.table_stream(spark, f"{sf}/documents.parquet").select(F.pmod("doc_id", F.lit(6)).cast("int").alias("worker"), F.length("text").cast("long").alias("chars"))
    return runs.drained(spark, rows, rows.schema).groupBy("worker").agg(F.count("*").alias("items"), F.sum("chars").alias("chars"))
