"""Registered queries on file sources and sinks: each writes its files to the shared folder first, and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import files
from ..streaming import runs
from .fixtures import view, with_views

QUERIES, SQL = {}, {}
_NAMES = ("png", "jpg", "jpeg", "webp", "txt", "PNG")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, kind: str) -> str:
    """A new folder that goes when the session's JVM ends."""
    path = runs.shared_path(spark, kind)
    runs.forget(spark, path)
    return path


def _image_folder(spark, sf) -> str:
    """A file for each nation, whose ending hangs on its key and whose bytes are its name."""
    where = _folder(spark, "images")
    found = view(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    files.put_files(spark, where, {f"n{r.n_nationkey}.{_NAMES[r.n_nationkey % 6]}": r.n_name.encode() for r in found})
    return where


_IMAGES = "SELECT 'n' || n_nationkey || '.' || ['png', 'jpg', 'jpeg', 'webp'][1 + n_nationkey % 6] AS file, CAST(length(n_name) AS BIGINT) AS bytes, md5(n_name) AS digest FROM nation WHERE n_nationkey % 6 < 4"


def _listed(found):
    return found.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("digest"))


@query(_IMAGES)
def image_files(spark, sf):
    """Raw bodies of the files with one of the four endings."""
    return _listed(files.images(spark, _image_folder(spark, sf)))


@query(_IMAGES)
def image_file_stream(spark, sf):
    stream = _listed(files.image_stream(spark, _image_folder(spark, sf)))
    return runs.drained(spark, stream, stream.schema)


@query("SELECT n_nationkey, n_nationkey % 6 < 4 AS found FROM nation WHERE n_nationkey < 6")
def first_existing(spark, sf):
    """Of two candidates, the one of an image ending, then one that is missing."""
    where = _image_folder(spark, sf)
    got = [(k, files.first_existing(spark, [f"{where}/none", *([f"{where}/n{k}.{_NAMES[k]}"] if k < 4 else [])]) is not None) for k in range(6)]
    return spark.createDataFrame(got, "n_nationkey long, found boolean")


@query(f"{with_views('yolo_labels')} SELECT split, CAST(class_id AS INT) AS class_id, count(*) AS instances FROM yolo_labels GROUP BY ALL")
def label_files(spark, sf):
    """Label lines, one file set a split; blank lines don't count."""
    where = _folder(spark, "labels")
    lines = view(spark, sf, "yolo_labels").select("split", F.concat("class_id", F.lit(" 0.5 0.5 0.1 0.1\n")).alias("value"))
    splits = ("train", "valid", "test")
    for s in splits:
        lines.where(F.col("split") == s).select("value").write.text(f"{where}/{s}/labels")
    whole = files.labels(spark, where, splits[0])
    for s in splits[1:]:
        whole = whole.unionByName(files.labels(spark, where, s))
    return stats.class_counts(whole.select("split", "class_id"))


@query("SELECT CAST(p_partkey AS INT) AS epoch, CAST(p_partkey % 100 AS DOUBLE) / 100 AS map50, CASE WHEN p_partkey % 100 >= 80 THEN 'excellent' WHEN p_partkey % 100 >= 60 THEN 'good' WHEN p_partkey % 100 >= 40 THEN 'fair' ELSE 'poor' END AS tier FROM part")
def metrics_log(spark, sf):
    """A training log as CSV, with blanks around names and values."""
    where = f"{_folder(spark, 'metrics')}/log"
    log = view(spark, sf, "part").select(F.col("p_partkey").alias("epoch"), F.concat(F.lit(" "), F.round((F.col("p_partkey") % 100) / 100, 2)).alias(" metrics/mAP50(B)"))
    log.write.csv(where, header=True)
    m = files.metrics(spark, where)
    return m.select("epoch", F.col("`metrics/mAP50(B)`").alias("map50"), stats.quality_tier(F.col("`metrics/mAP50(B)`")).alias("tier"))


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7")
def debug_readback(spark, sf):
    """One session's artifacts out of all; only its folder is read."""
    where = _folder(spark, "debug")
    files.write_debug(view(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "event_type", "value"), where)
    return files.read_debug(spark, where, "7", "event_id long, event_type string, value double").select("event_id", "event_type", "value")


@query("""WITH s AS (SELECT event_type AS variant, avg(value) AS mean_ms FROM events GROUP BY 1), b AS (SELECT mean_ms AS base FROM s WHERE variant = 'click')
 SELECT variant, printf('%.3f', mean_ms) AS mean_ms, printf('%.2fx', base / mean_ms) AS speedup FROM s, b""")
def report_lines(spark, sf):
    """The report's lines, read back."""
    where = f"{_folder(spark, 'report')}/lines"
    files.write_report(stats.latency(view(spark, sf, "stage_timings"), "variant", "elapsed_ms"), where, "click")
    cut = F.split("value", " \\| ")
    return spark.read.text(where).select(F.ltrim(F.regexp_replace(cut[0], "^\\|", "")).alias("variant"), cut[1].alias("mean_ms"), F.rtrim(F.regexp_replace(cut[5], "\\|$", "")).alias("speedup"))


@query("SELECT md5(text) AS key, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def persisted_cache(spark, sf):
    """Results by the hash of their content, in two batches; the last write of a key wins."""
    d = view(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id")
    where = f"{_folder(spark, 'cache')}/none"
    first = runs.upsert_cache(d.where("doc_id % 2 = 0"), where, "key", "doc_id")
    return runs.upsert_cache(d.where("doc_id % 2 = 1"), first.inputFiles()[0].rpartition("/")[0], "key", "doc_id") if first.head(1) else first


@query("SELECT n_nationkey::INT AS class_id, n_name AS name, 25 AS classes, 'images/train' AS train FROM nation")
def dataset_config(spark, sf):
    """A dataset's YAML file, written and read back: its classes by number."""
    where = _folder(spark, "config")
    names = [r.n_name for r in view(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 rows
    lines = ["# dataset", "train: images/train", f"nc: {len(names)}", "names:", *[f"  - '{x}'" for x in names]]
    files.put_files(spark, where, {"data.yaml": "\n".join(lines).encode()})
    found = files.config(spark, f"{where}/data.yaml")
    rows = [(i, x, found["nc"], found["train"]) for i, x in enumerate(found["names"])]
    return spark.createDataFrame(rows, "class_id int, name string, classes int, train string")
