"""Streams over files, drained to tables: in-order rows, keyed write-through caches, and one row out for each row in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and executors share (a local default in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/glyphflow-streams/{kind}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Makes the folder, and lets it go when the session's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; a single file is read through its folder and a name filter."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(spark: SparkSession, stream: DataFrame, schema, interval: str | None = None, step=None) -> DataFrame:
    """All rows that the stream yields for what is there now, written to a shared folder and read back.

    Each batch has a folder named by its number and replaces what a failed attempt left there, so no row is written twice.
    States go when the stream has ended, rows when the session's JVM ends. With an interval ("1 second") batches start by the
    clock, as for a stream that runs on. `step`, a function of the output folder, gives another step for each batch, which
    writes below rows.
    """
    out, state = shared_path(spark, "rows"), shared_path(spark, "state")
    each = step(out) if step else lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(**trigger).start()
    if interval:
        q.processAllAvailable()
        q.stop()
    else:
        q.awaitTermination()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hadoop(state).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(state), True)
    forget(spark, out)
    return spark.read.schema(schema).parquet(f"{out}/rows").select(*schema.names if hasattr(schema, "names") else [x.split()[0] for x in schema.split(", ")])


def upsert_cache(batch: DataFrame, cache_path: str, key: str, order: str) -> DataFrame:
    """Last write of each key wins; returns the new cache. For foreachBatch; the old table is read before it is replaced."""
    spark = batch.sparkSession
    try:
        whole = batch.unionByName(spark.read.parquet(cache_path))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        whole = batch
    cols = [c for c in batch.columns if c != key]
    latest = whole.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")
    target = shared_path(spark, "cache")
    latest.write.parquet(target)
    forget(spark, target)
    return spark.read.parquet(target)
