"""Requests and settings: JSON bodies to image rows, validation, keyed stores with defaults."""

from __future__ import annotations

import base64
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cache import strip_data_uri

REQUEST = "base64Images array<string>, targetLanguage string"
MAX_IMAGES = 5


def parsed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """images, target_language ('English' if none) and valid (1 to 5 images) of JSON bodies; broken ones are invalid."""
    r = F.from_json(body, REQUEST)
    n = F.coalesce(F.size(r["base64Images"]), F.lit(0))
    return bodies.withColumns({"images": r["base64Images"], "target_language": F.coalesce(r["targetLanguage"], F.lit("English")), "valid": (n >= 1) & (n <= MAX_IMAGES)})


def image_rows(requests: DataFrame) -> DataFrame:
    """A row for each image of valid requests, with its bytes."""
    rows = requests.where("valid").select(*[c for c in requests.columns if c not in ("images", "valid", "body")], F.posexplode("images").alias("image_idx", "uri"))
    return rows.withColumn("content", F.unbase64(strip_data_uri(F.col("uri")))).drop("uri")


def frame_rows(frames: DataFrame, content: str = "content") -> DataFrame:
    """success and error in-band for each binary frame: empty or missing frames fail."""
    bad = F.col(content).isNull() | (F.octet_length(content) == 0)
    return frames.withColumns({"success": ~bad, "error": F.when(bad, "Failed to decode image")})


def prefixed(key: Column, prefix: str = "app-") -> Column:
    return F.concat(F.lit(prefix), key)


def read_through(cache: DataFrame, backend: DataFrame, key: str) -> DataFrame:
    """Each key's value from the cache, else from the backend."""
    both = cache.select(key, F.col("value").alias("_c")).join(backend.select(key, F.col("value").alias("_b")), key, "full")
    return both.select(key, F.coalesce("_c", "_b").alias("value"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Field by field, a change's values over the stored ones; new keys are added."""
    fields = [c for c in table.columns if c != key]
    joined = table.alias("t").join(changes.alias("c"), key, "full")
    return joined.select(key, *[F.coalesce(F.col(f"c.{f}"), F.col(f"t.{f}")).alias(f) for f in fields])


def reset(table: DataFrame, keys: DataFrame, key: str, defaults: dict) -> DataFrame:
    """The table with the defaults in all fields of the keys given (null for fields without one); others stay."""
    gone = keys.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    rows = table.join(gone, F.col(key) == F.col("_k"), "left")
    types = dict(table.dtypes)
    return rows.select(*[c if c == key else F.when(F.col("_k").isNotNull(), F.lit(defaults.get(c)).cast(types[c])).otherwise(F.col(c)).alias(c) for c in table.columns])


def fetched(rows: DataFrame, url: str, timeout_s: float = 30.0) -> DataFrame:
    """Adds success, content (a data URI) and error: what each address holds, fetched by the workers, each address once.

    Addresses that can't be read, and null ones, say so in-band. Any scheme that urllib opens will do, but local files.
    """

    @F.pandas_udf("success boolean, content string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([_fetch(x, timeout_s) for x in s], columns=["success", "content", "error"])

    asked = rows.select(F.col(url).alias("_u")).where("_u is not null").distinct()
    got = asked.select("_u", run.asNondeterministic()("_u").alias("_r"))
    found = rows.join(got, F.col(url) == F.col("_u"), "left")
    error = F.when(F.col("_u").isNull(), "no address").otherwise(F.col("_r.error"))
    return found.withColumns({"success": F.coalesce("_r.success", F.lit(False)), "content": F.col("_r.content"), "error": error}).drop("_u", "_r")


def _fetch(url: str, timeout_s: float) -> tuple[bool, str | None, str | None]:
    try:
        if url.split(":", 1)[0].lower() == "file":
            raise ValueError("local files are not fetched")
        with urllib.request.urlopen(url, timeout=timeout_s) as r:
            return True, f"data:{r.headers.get_content_type()};base64,{base64.b64encode(r.read()).decode()}", None
    except Exception as e:
        return False, None, str(e)
