"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records and bytes in one Arrow batch that Python workers receive; bounds a worker's memory.
BATCH_ROWS = 1000
#: A-Z to a-z, and all ASCII bytes that are no word bytes to a space; bytes of other code points stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)


def lower_words(text: bytes) -> list[bytes]:
    """Whitespace-separated words (space and \\t to \\r), A-Z in lower case."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Maximal runs of 0-9, a-z (A-Z in lower case) and all code points from U+0080."""
    return text.translate(ALNUM).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local default in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            found = made.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"  # one process, as in tests
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows at once, as texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: The session's setting by which the files of a query's shuffles go when it has ended (from Spark 4.1; without effect before).
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the time of the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder. They cut lineage, so that a lost executor costs no repeated work.

    Tables that no later result reads go with drop() or close(), or at the end of a `dropping()` block; the others go when
    the session's JVM ends.
    """

    opened: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        bound_batches(spark)
        if Scratch.opened:
            Scratch.opened[-1].append(self)

    def close(self) -> None:
        self.drop(*[df for _, df in self.paths.values()])

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/glyphflow/{uuid.uuid4().hex}"
        with setting(self.spark, CLEAN_UP, "true"):  # what df shuffles is read by this write alone
            df.write.parquet(path)
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (where, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if (found := self.paths.pop(id(df), None)) is not None:
                found[0].getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(found[0], True)


@contextmanager
def dropping():
    """Drops at its end all tables of the Scratches that were opened in it."""
    Scratch.opened.append([])
    try:
        yield
    finally:
        for scratch in Scratch.opened.pop():
            scratch.close()


def texts(df: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """The kept columns, and the text as UTF-8 bytes under the name _text; a null text becomes empty."""
    own = [F.col(f"`{c}`") for c in keep]
    return df.select(*own, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"))


def decoded(text: bytes) -> str:
    """Bytes that are no UTF-8 (Spark strings may hold them) become U+FFFD."""
    return text.decode("utf-8", "replace")


def text_column(batch: pa.RecordBatch, name: str = "_text") -> list[bytes]:
    return batch.column(name).to_pylist()


def slices(batches, rows: int = BATCH_ROWS, size: int = 8 << 20):
    """Arrow batches cut to at most the given rows and, where there is more than one row, about the given bytes of _text."""
    for batch in batches:
        at = 0
        col = batch.column("_text")
        lengths = pc.binary_length(col).to_pylist()
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or total + (lengths[end] or 0) <= size):
                total += lengths[end] or 0
                end += 1
            yield batch.slice(at, end - at)
            at = end


def gathered(batches, size: int = 8 << 20):
    """Arrow batches put together to about the given bytes of _text."""
    held, total = [], 0
    for batch in slices(batches, size=size):
        held.append(batch)
        total += batch.column("_text").nbytes
        if total >= size:
            yield whole(held)
            held, total = [], 0
    if held:
        yield whole(held)


def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def word_lists(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """lower_words() of all rows' _text one after another, as an Arrow array of bytes, and where each row's begin (and the last end)."""
    col = batch.column("_text").cast(pa.binary())
    text = pa.Array.from_buffers(pa.string(), len(col), col.buffers(), offset=col.offset)  # ASCII kernels take any bytes
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    found = flat.filter(full)
    return pa.Array.from_buffers(pa.binary(), len(found), found.buffers(), offset=found.offset), before[offsets - offsets[0]]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of bytes: data cut at ends, which begin with 0 and count its elements."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., and their names by the old ones, so that no column clashes with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


def map_texts(df: DataFrame, text_col: str, keep: list[str], schema: str, each) -> DataFrame:
    """A map-only pass: each(texts, batch) gives one list of values per row, appended to the kept columns.

    schema names and types what is appended; a kept column of the same name gives way to it. Nothing is shuffled, and a lost task repeats only its own split.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    bound_batches(df.sparkSession)
    added = StructType.fromDDL(schema)
    names = {f.name.lower() for f in added.fields}
    keep = [c for c in keep if c.lower() not in names]
    n_keep = len(keep)
    source = texts(df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text")), "text", *[f"k{i}" for i in range(n_keep)])
    out = StructType([StructField(c, f.dataType) for c, f in zip(keep, source.schema.fields)] + added.fields)
    arrow = to_arrow_schema(out)

    def run(batches):
        for part in slices(batches):
            rows = each(text_column(part), part)
            cols = [part.column(i).cast(arrow.field(i).type) for i in range(n_keep)]
            values = list(zip(*rows)) if rows else [()] * len(added)
            cols += [pa.array(v, type=arrow.field(n_keep + k).type) for k, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return source.mapInArrow(run, out)


def file_bytes(path: str) -> bytes:
    """A vocabulary or rule file of fixed size, read on the driver and broadcast by the caller."""
    with open(path, "rb") as f:
        return f.read()
