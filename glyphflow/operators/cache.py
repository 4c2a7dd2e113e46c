"""Content keys, memoised calls, in-flight control and small look-ups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

IN_FLIGHT, ATTEMPTS, BASE_MS = 3, 3, 1000


def cache_key(lang: Column, model: Column, data: Column) -> Column:
    return F.concat(lang, F.coalesce(model, F.lit(":unknown:")), F.md5(data))


def memoised(rows: DataFrame, key: str, compute, cached: DataFrame) -> DataFrame:
    """Values from the cache where the key is known; each other key is computed once, however often it occurs.

    cached: key and value, a row a key. compute(distinct keys) gives key and value. The look-up is a join on the key.
    """
    missing = rows.select(key).distinct().join(cached, key, "left_anti")
    table = cached.select(key, "value").unionByName(compute(missing).select(key, "value"))
    return rows.join(table, key, "left")


def first_in_flight(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first request of each key; combined before the shuffle, so a hot key is one row a task."""
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*fields), F.col(order)).alias("r")).select(*[key if c == key else F.col(f"r.{c}") for c in rows.columns])


def admitted(rows: DataFrame, key: str, start: str, hold_s: int, limit: int = IN_FLIGHT, order: str | None = None, identity: str | None = None) -> DataFrame:
    """Requests that find fewer than `limit` admitted ones of their key still running; each admitted one runs for hold_s seconds.

    With `identity`, a request for what is running already is rejected too. Rejected requests take no place. A key's
    requests are taken by time, those of equal time by `order`, in one pass whose state is the running ones' end times and
    identities. A request without a time finds none running and takes no place.
    """
    at = F.unix_micros(F.col(start).cast("timestamp"))
    schema = StructType([*rows.schema.fields, StructField("running", LongType()), StructField("admitted", BooleanType())])
    arrow, width = to_arrow_schema(schema), len(rows.columns)

    def run(batches):
        now, ends = None, []  # at most `limit` (end time, identity)
        for batch in batches:
            running, taken = [], []
            for k, t, own in zip(batch.column("_key").to_pylist(), batch.column("_at").to_pylist(), batch.column("_own").to_pylist()):
                if (k,) != now:
                    now, ends = (k,), []
                if t is None:
                    running.append(0)
                    taken.append(True)
                    continue
                ends = [e for e in ends if e[0] > t]
                running.append(len(ends))
                taken.append(len(ends) < limit and (own is None or all(own != x for _, x in ends)))
                if taken[-1]:
                    ends.append((t + hold_s * 1_000_000, own))
            out = [batch.column(i).cast(arrow.field(i).type) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(running, pa.int64()), pa.array(taken, pa.bool_())], schema=arrow)

    named = rows.withColumns({"_key": F.col(key), "_at": at, "_own": F.col(identity).cast("string") if identity else F.lit(None).cast("string")})
    dealt = named.repartition(F.col("_key")).sortWithinPartitions("_key", "_at", *([order] if order else []))
    return dealt.mapInArrow(run, schema)


def round_robin(idx: Column, instances: int) -> Column:
    return F.pmod(idx, F.lit(instances)).cast("int")


def backoff(n: int = ATTEMPTS, base: int = BASE_MS) -> Column:
    """Waits after each failed attempt but the last."""
    return F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: (F.lit(base) * F.pow(F.lit(2), k - 1)).cast("long"))


def djb2(t: Column) -> Column:
    """32-bit multiply-xor hash of an ASCII text, as 8 hex digits."""
    step = lambda h, c: ((h * F.lit(33)).bitwiseAND(F.lit(4294967295))).bitwiseXOR(F.ascii(c).cast("long"))
    h = F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(5381).cast("long"), step)
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def fingerprint(t: Column) -> Column:
    """The hash of the text, then those of its four quarters."""
    size = F.ceil(F.length(t) / 4).cast("int")
    return F.concat(djb2(t), *[djb2(F.substring(t, size * k + 1, size)) for k in range(4)])


# Supported languages in their order, those written vertically, and fonts by language.
LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "id", "it", "ja", "ko", "pl", "pt-BR", "pt-PT", "ru", "th", "vi", "zh-CN", "zh-TW")
VERTICAL = ("ja", "zh-CN", "zh-TW")
FONTS = ("CC Wild Words", "CC Victory Speech")
OWN_FONTS = {"ar": "NotoSansAR-Regular", "hi": "NotoSansHI-Regular", "ja": "NotoSansJP-Regular", "ko": "NoonnuBasicGothicRegular", "th": "NotoSansTH-Regular", "vi": "BlambotClassiciCiel-Regular", "zh-CN": "system-ui", "zh-TW": "system-ui"}
LINE_HEIGHTS = {"CC Victory Speech": 1.05, "NoonnuBasicGothicRegular": 1.25}
LINE_HEIGHT = 1.13


def font_options(code: Column) -> Column:
    """The fonts offered for a language; none for unsupported ones."""
    out = F.when(code.isin(*LANGUAGES), F.array(*[F.lit(f) for f in FONTS])).otherwise(F.expr("cast(array() as array<string>)"))
    for lang, font in OWN_FONTS.items():
        out = F.when(code == lang, F.array(F.lit(font))).otherwise(out)
    return out


def line_height(font: Column) -> Column:
    out = F.lit(LINE_HEIGHT)
    for name, value in LINE_HEIGHTS.items():
        out = F.when(font == name, F.lit(value)).otherwise(out)
    return out


def language_or_default(code: Column) -> Column:
    """The code if supported, else the first that starts with its short form, else English."""
    known = F.array(*[F.lit(c) for c in LANGUAGES])
    short = F.split(code, "-")[0]
    return F.when(F.array_contains(known, code), code).otherwise(F.coalesce(F.get(F.filter(known, lambda c: F.startswith(c, short)), F.lit(0)), F.lit("en")))


def font_choice(options: Column, stored: Column, default: Column) -> Column:
    """No option: the system's; one: that; else the stored one if offered, the default if offered, the first."""
    return F.when(F.size(options) == 0, "system-default").when(F.size(options) == 1, F.get(options, F.lit(0))).when(F.array_contains(options, stored), stored).when(F.array_contains(options, default), default).otherwise(F.get(options, F.lit(0)))


def error_rows(status: Column) -> Column:
    """What a failed call shows instead of translations; null for a good one."""
    row = lambda text: F.array(F.struct(F.lit("Unknown").alias("originalLanguage"), F.lit(text).alias("translatedText"), F.lit(0).alias("minX"), F.lit(0).alias("minY"), F.lit(200).alias("maxX"), F.lit(200).alias("maxY")))
    return F.when(status == 500, row("Server is down or experiencing issues. Sorry for the inconvenience.")).when(status == 429, row("Out of translations. Server costs are expensive. Upgrade for more!"))


def strip_data_uri(t: Column) -> Column:
    """What follows the first comma of a data URI; other texts as they are."""
    return F.when(F.startswith(t, F.lit("data:image")) & (F.instr(t, ",") > 0), F.regexp_replace(t, "^[^,]*,", "")).otherwise(t)


def encoded(content: Column) -> Column:
    """Base64 in one line; Spark's own has line breaks."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def base64_mb(t: Column) -> Column:
    return F.length(t).cast("double") * 3 / 4 / (1024 * 1024)


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))
