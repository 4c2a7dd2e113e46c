"""Files as tables: images, label lists, metrics, reports, recognised pages; and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import encoded

IMAGE_GLOB = "*.{jpg,jpeg,png,webp}"
REPORT = "timestamp string, device_info map<string, string>, config map<string, string>, benchmarks map<string, struct<mean_ms: double, median_ms: double, std_ms: double, min_ms: double, max_ms: double, p50_ms: double, p95_ms: double, p99_ms: double, cv_percent: double, fps: double, iterations: int>>"
DEBUG_FOLDERS = 64  # where files are hangs on it
OCR_PAGE = "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<int>>>, rec_boxes array<array<int>>"


def images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and content of the image files below a folder; columns that aren't used aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", str(recursive).lower()).load(path)


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of new files."""
    schema = spark.read.format("binaryFile").load(path).schema
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", IMAGE_GLOB).load(path)


def data_uri(content: Column, media_type: Column) -> Column:
    """An upload as a data URI; without a media type it counts as JPEG."""
    return F.concat(F.lit("data:"), F.coalesce(media_type, F.lit("image/jpeg")), F.lit(";base64,"), encoded(content))


def chunks_joined(chunks: DataFrame, key: str, seq: str, data: str) -> DataFrame:
    """Bodies from their ordered text chunks."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, data))), lambda x: x[data]), "").alias(data))


def labels(spark: SparkSession, root: str, split: str) -> DataFrame:
    """file, class_id of the label lines of a split; a line's first field is the class, empty lines don't count."""
    lines = spark.read.text(f"{root}/{split}/labels/*.txt").select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), "\\s+").alias("f"))
    return lines.where(F.col("f")[0] != "").select(F.lit(split).alias("split"), "file", F.col("f")[0].cast("int").alias("class_id"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """A training log: epoch as int, all others as double; names without spaces at the ends."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.trim(F.col(f"`{c}`")).cast("int" if c.strip() == "epoch" else "double").alias(c.strip()) for c in raw.columns])


def report(spark: SparkSession, path: str) -> DataFrame:
    """A row for each benchmark in a report."""
    return spark.read.schema(REPORT).json(path, multiLine=True).select("timestamp", F.explode("benchmarks").alias("variant", "s")).select("timestamp", "variant", "s.*")


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each recognised text of a page: parallel arrays, cut to the shortest."""
    from ..operators.pages import zip_shortest

    pages = spark.read.schema(OCR_PAGE).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("page"), "*")
    z = zip_shortest(F.col("rec_texts"), F.col("rec_scores"), F.col("rec_polys"))
    return pages.select("page", F.posexplode(z).alias("idx", "z")).select("page", "idx", F.col("z.rec_texts").alias("text"), F.col("z.rec_scores").alias("score"), F.col("z.rec_polys").alias("points"))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists in its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    return None


def config(spark: SparkSession, path: str) -> dict:
    """A small YAML file of a dataset or a training run, read through its file system; {} for an empty one."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml module") from e
    row = spark.read.text(path, wholetext=True).head()
    return (yaml.safe_load(row.value) if row else None) or {}


def put_files(spark: SparkSession, folder: str, contents: dict[str, bytes]) -> None:
    """A few small files, written by the driver through the folder's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, content in contents.items():
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = where.getFileSystem(conf).create(where, True)
        out.write(bytearray(content))
        out.close()


def folder_sizes(listing: DataFrame, root: str) -> DataFrame:
    """Bytes and files of each top folder; listing: path and length, as binaryFile gives them."""
    rest = F.substring_index("path", root.rstrip("/") + "/", -1)
    return listing.groupBy(F.substring_index(rest, "/", 1).alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def write_report(stats: DataFrame, path: str, baseline: str) -> None:
    """Markdown lines of latency statistics: one a variant, in order, with the speed-up over the baseline."""
    from ..operators.stats import against_baseline

    rows = against_baseline(stats, "variant", baseline, "mean_ms")
    line = F.format_string("| %s | %.3f | %.3f | %.3f | %.1f | %s |", "variant", "mean_ms", "p95_ms", "p99_ms", "fps", F.coalesce(F.format_string("%.2fx", "speedup"), F.lit("-")))
    rows.orderBy("variant").select(line.alias("value")).coalesce(1).write.text(path)


def _bucket(session_id: Column) -> Column:
    return F.pmod(F.hash(session_id), F.lit(DEBUG_FOLDERS))


def write_debug(rows: DataFrame, path: str) -> None:
    """Artifacts by session: sessions are dealt over a fixed number of folders, as a folder each is a file or more each.

    A folder's rows go to few tasks, so that there are few files; a large session is split again. Lines are packed, as they are
    several times the size of a table's rows.
    """
    rows = rows.withColumn("session_bucket", _bucket(F.col("session_id"))).hint("rebalance", "session_bucket")
    rows.write.mode("append").partitionBy("session_bucket").json(path, compression="gzip")


def read_debug(spark: SparkSession, path: str, session_id: str, schema: str) -> DataFrame:
    """One session's artifacts; only the folder that it is dealt to is read."""
    found = spark.read.schema(f"{schema}, session_id string, session_bucket int").json(path)
    return found.where((F.col("session_bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id)).drop("session_bucket")
