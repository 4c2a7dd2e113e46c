"""Suffix-array dedup: removes each byte covered by a SPAN-byte string that also starts anywhere else.

Which suffixes are sorted. Among the first REACH starts of any SPAN-byte string, the one whose next 8 bytes hash lowest (of
equal ones the last) is its anchor; equal strings have their anchor at the same offset. So only suffixes at anchors are
sorted first, about 2 in REACH: all suffixes would be 64 times as many records. An anchor's unit is the run of strings
whose anchor it is, one start after the other. A suffix is ordered by its leading LEAD bytes of text, which any string of
the unit holds, and then by a 128-bit digest of the unit's bytes. Units that are alone with their leading bytes hold no
repeated string; units with an equal neighbour in bytes and digest hold only repeated strings. The strings of units that
share just the leading bytes, and of one of each set of equal units beside them, are sorted as suffixes of their own in a
second round, by their first bytes and a 128-bit digest of all SPAN.

How they are sorted. Splitters are drawn from a sample of the suffixes themselves, spread over rows and within long rows;
suffixes are range-partitioned by them in order of their text; each bucket sorts by multikey quicksort, eight bytes at a
time among those that tie, and compares neighbours. What decides at a bucket's ends is compared across boundaries: two
suffixes a bucket, in a table. Suffixes that are equal throughout and fill several buckets are dealt over all of them, so a
passage that stands in a third of all documents is no hot spot; the splitters only balance.

Documents are known by 96 bits of hashes of id and text, so that lost tasks repeat alike; texts are joined to the spans by
them. Nulls are empty texts. Repeated rows are copies of each other, and all their bytes in repeated strings go. Matches
never cross documents. Very long texts are read in pieces. drop_repeats() keeps whole code points, and bytes that are no
UTF-8 become U+FFFD there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, decoded, neutral, slices, text_column, texts

SPAN, REACH = 200, 128
#: Leading bytes that order suffixes at anchors (any string of SPAN bytes holds SPAN - REACH + 1 from its anchor on), and single strings.
LEAD, STRING_LEAD = 64, 8
#: Suffixes in a bucket as planned, keys in the sample for a bucket and at least, bytes that are worked on at once.
BUCKET_ROWS, SAMPLE_KEYS, LEAST_KEYS, CHUNK = 1 << 18, 16, 4096, 1 << 20
#: Of a sampled row (or piece of PIECE bytes of a longer one), every STEP-th suffix is in the sample.
PIECE, STEP = 1 << 16, 16


def units(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, last start, anchor) of all units of the documents that stand in a buffer one after another."""
    empty = np.zeros(0, dtype=np.int64)
    if len(buffer) < SPAN:
        return empty, empty, empty, empty
    raw = np.frombuffer(buffer, dtype=np.uint8)
    n = len(raw) - 7
    value = np.lib.stride_tricks.as_strided(raw, shape=(n, 8), strides=(1, 1)).copy().view(np.uint64).ravel()
    value *= np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value &= np.uint64(0xFFFFFFFF00000000)
    value |= np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)  # of equal hashes the last
    low, width = value, 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH:
        low = np.minimum(low[: n - REACH + 1], low[REACH - width : REACH - width + n - REACH + 1])
    count = ends - starts - SPAN + 1  # strings of each document
    has = np.where(count > 0)[0]
    if not len(has):
        return empty, empty, empty, empty
    total = int(count[has].sum())
    before = np.cumsum(count[has]) - count[has]
    at = np.arange(total) - np.repeat(before, count[has]) + np.repeat(starts[has], count[has])
    doc = np.repeat(has, count[has])
    anchor = (np.uint64(0xFFFFFFFF) - (low[at] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first = np.where(new)[0]
    last = np.concatenate([first[1:], [total]]) - 1
    return doc[first], at[first], at[last], anchor[first]


def chunks(rows):
    """(row, offset, bytes) gathered to about CHUNK bytes. Longer texts come in pieces that overlap by SPAN - 1; each string starts in one."""
    group, size = [], 0
    for row, t in rows:
        for base in range(0, max(1, len(t) - SPAN + 1), CHUNK):
            piece = t[base : base + CHUNK + SPAN - 1] if len(t) > CHUNK else t
            group.append((row, base, piece))
            size += len(piece)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


#: What travels with each suffix beside its leading bytes and digest.
PLACE = (("row", "<i8"), ("tag", "<i4"), ("first", "<u4"), ("more", "u1"))
#: Records that a task gathers before it sends them to their buckets.
FLUSH = 100_000


def leading(buffer: bytes, at: np.ndarray, size: int) -> np.ndarray:
    """The next `size` bytes at each place, as numbers of eight bytes that sort like them; a line each."""
    raw = np.frombuffer(buffer, dtype=np.uint8)
    return np.ascontiguousarray(raw[at[:, None] + np.arange(size)]).view(">u8").astype(np.uint64)


def digests(view, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    of = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([of(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())]), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def unit_records(group):
    """(keys, row, tag, first, more) of suffixes at anchors: a line of leading bytes and digest each, the row, the unit's first start there, and how many more starts it has."""
    buffer = b"".join(t for _, _, t in group)
    ends = np.cumsum([len(t) for _, _, t in group])
    starts = ends - np.array([len(t) for _, _, t in group])
    doc, lo, hi, anchor = units(buffer, starts, ends)
    keys = np.hstack([leading(buffer, anchor, LEAD), digests(memoryview(buffer), lo, hi + SPAN)])
    rows, tags = (np.array([r[k] for r, _, _ in group], dtype=np.int64) for k in (0, 1))
    shift = np.array([b for _, b, _ in group], dtype=np.int64) - starts
    return keys, rows[doc], tags[doc], lo + shift[doc], hi - lo


def string_records(row: tuple, text: bytes, spans: list[tuple[int, int]], step: int = 1, size: int = 100_000):
    """The same columns for each string (or every step-th) that starts in the spans [first, last], a part at a time."""
    view = memoryview(text)
    at = np.concatenate([np.arange(a, b + 1) for a, b in spans])[::step] if spans else np.zeros(0, dtype=np.int64)
    for begin in range(0, len(at), size):
        p = at[begin : begin + size]
        yield np.hstack([leading(text, p, STRING_LEAD), digests(view, p, p + SPAN)]), np.full(len(p), row[0], dtype=np.int64), np.full(len(p), row[1], dtype=np.int64), p, np.zeros(len(p), dtype=np.int64)


def pack(cols, at: np.ndarray) -> bytes:
    """Many records of one bucket as one value, column after column."""
    return b"".join([cols[0][at, k].astype(">u8").tobytes() for k in range(cols[0].shape[1])] + [c[at].astype(t).tobytes() for c, (_, t) in zip(cols[1:], PLACE)])


def unpack(blobs: list[bytes], words: int) -> dict[str, np.ndarray]:
    """keys (a column for each eight bytes) and the columns of PLACE."""
    layout = [*[(f"w{k}", ">u8") for k in range(words)], *PLACE]
    width = sum(np.dtype(t).itemsize for _, t in layout)
    parts: dict[str, list] = {n: [] for n, _ in layout}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, t in layout:
            parts[name].append(np.frombuffer(blob, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
    out = {name: np.concatenate(x) for name, x in parts.items()}
    return {"keys": [out.pop(f"w{k}").astype(np.uint64) for k in range(words)], **out}


def multikey_sort(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order by the first key, then by the next ones among equals only; and for each depth, where runs begin."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="quicksort")
    sorted_key = keys[0][order]
    begins = np.ones(n, dtype=bool)
    begins[1:] = sorted_key[1:] != sorted_key[:-1]
    depths = [begins]
    for key in keys[1:]:
        begins = begins.copy()
        alone = begins & np.append(begins[1:], True)
        tied = np.where(~alone)[0]
        if len(tied):
            run, value = np.cumsum(begins)[tied], key[order[tied]]
            sub = np.lexsort((value, run))
            order[tied], value = order[tied][sub], value[sub]
            begins[tied[1:]] |= (value[1:] != value[:-1]) | (run[1:] != run[:-1])
        depths.append(begins)
    return order, depths


def run_lengths(begins: np.ndarray) -> np.ndarray:
    """For each place the length of its run."""
    at = np.where(begins)[0]
    sizes = np.diff(np.append(at, len(begins)))
    return np.repeat(sizes, sizes)


def key_strings(keys: np.ndarray) -> np.ndarray:
    """Lines of numbers as strings that sort like them."""
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{8 * keys.shape[1]}").ravel() if len(keys) else np.zeros(0, dtype=f"S{8 * keys.shape[1]}")


class Splitters:
    """Sampled keys in order; a suffix goes to the bucket between the splitters around it."""

    def __init__(self, sample: np.ndarray, buckets: int):
        keys = np.sort(sample)
        self.keys = keys[np.linspace(0, len(keys), buckets + 1).astype(int)[1:-1]] if len(keys) and buckets > 1 else keys[:0]

    def bucket(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Keys that several splitters equal are dealt over those buckets."""
        key = key_strings(keys)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        return lo + (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % (hi - lo + 1)


def sampled(rows: DataFrame, records, words: int) -> np.ndarray:
    """Keys on the driver: SAMPLE_KEYS a bucket on the average, LEAST_KEYS at least."""

    def run(batches):
        for keys, *_ in records(batches):
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.astype(">u8").tobytes()[i : i + 8 * words] for i in range(0, 8 * words * len(keys), 8 * words))} if len(keys) else {"key": pa.array([], pa.binary())})

    found = rows.mapInArrow(run, "key binary").toArrow().column("key").to_pylist()
    return np.array(found, dtype=f"S{8 * words}")


def sample_share(expected: int, spark) -> float:
    """The share of the suffixes that is sampled."""
    return min(1.0, max(LEAST_KEYS, SAMPLE_KEYS * bucket_count(expected, spark)) / max(1, expected))


def bucket_count(expected: int, spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // BUCKET_ROWS))


def sorted_buckets(rows: DataFrame, records, sample: np.ndarray, expected: int, scratch: Scratch, lead: int, part: bool = True) -> tuple[DataFrame, DataFrame]:
    """(row, tag, first, last, full): records that share the leading bytes with another one, full if the digest too; and the written table below.

    Where records of one lead differ in the digest, one of each set of equal ones comes a second time as not full.
    Without part, full ones only. records(batches) gives keys (lead bytes and the digest) and the columns of PLACE.
    """
    spark = rows.sparkSession
    buckets, words = bucket_count(expected, spark), lead // 8 + 2
    splitters = spark.sparkContext.broadcast(Splitters(sample, buckets))  # one key a bucket

    def deal(batches):
        held, size = [], 0

        def out():
            cols = [np.concatenate(x) for x in zip(*held)]
            bucket = splitters.value.bucket(cols[0], cols[1] + cols[3])
            order = np.argsort(bucket, kind="stable")
            present, begin = np.unique(bucket[order], return_index=True)
            blobs = [pack(cols, at) for at in np.split(order, begin[1:])]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(present, pa.int32()), "data": pa.array(blobs, pa.binary())})

        for cols in records(batches):
            if len(cols[0]):
                held.append(cols)
                size += len(cols[0])
            if size >= FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    scheme = "row long, tag int, first long, last long, full boolean, bucket int, side int, lead binary, digest binary"
    names = [x.split()[0] for x in scheme.split(", ")]

    def work(batches):
        blobs, own = [], None
        for b in batches:
            blobs += b.column("data").to_pylist()
            own = b.column("bucket")[0].as_py() if b.num_rows else own
        if not blobs:
            return
        cols = unpack(blobs, words)
        blobs.clear()
        order, depths = multikey_sort(cols["keys"])
        shared, full = run_lengths(depths[-3]) > 1, run_lengths(depths[-1]) > 1
        n = len(order)
        # one of each run of equal records stands for it among the others with its lead; runs at the ends may have others beyond
        run = np.cumsum(depths[-3]) - 1
        mixed = np.bincount(run, weights=~full) > 0
        mixed[[0, -1]] = True
        stands = np.where(depths[-1] & full & mixed[run])[0]
        hit = np.concatenate([np.where(shared)[0], stands]) if part else np.where(full)[0]
        full_hit = np.concatenate([full[shared], np.zeros(len(stands), dtype=bool)]) if part else np.ones(len(hit), dtype=bool)

        def batch(x, whole, *more):
            first = cols["first"][x].astype(np.int64)
            given = [pa.array(cols["row"][x]), pa.array(cols["tag"][x]), pa.array(first), pa.array(first + cols["more"][x]), pa.array(whole)]
            more = more or [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*given, *more], names=names)

        for a in range(0, len(hit), 50_000):
            yield batch(order[hit[a : a + 50_000]], full_hit[a : a + 50_000])
        # the bucket's first and last suffix, for the comparison across boundaries
        x = order[[0, n - 1]]
        key = [b"".join(int(c[i]).to_bytes(8, "big") for c in cols["keys"]) for i in x.tolist()]
        yield batch(x, full[[0, n - 1]], pa.array([own, own], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([k[:lead] for k in key], pa.binary()), pa.array([k[lead:] for k in key], pa.binary()))

    dealt = rows.mapInArrow(deal, "bucket int, data binary").repartitionById(buckets, F.col("bucket"))
    found = scratch.write(dealt.mapInArrow(work, scheme))
    # across boundaries: a bucket's last suffix and the first of the next bucket that has any; two rows a bucket
    in_order = Window.orderBy("bucket", "side")
    beside = lambda c: F.when(F.col("side") == 0, F.lag(c).over(in_order)).otherwise(F.lead(c).over(in_order))
    edges = found.where("side is not null").select("*", beside("bucket").alias("b"), beside("lead").alias("l"), beside("digest").alias("d")).where("b <> bucket and l = lead")
    more = edges.select("row", "tag", "first", "last", F.explode(F.array(F.col("d") == F.col("digest"), F.lit(False))).alias("full")).where(F.lit(part) | F.col("full"))
    return found.where("side is null").select("row", "tag", "first", "last", "full").union(more), found


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of bytes covered by strings that start in [first, last]."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + SPAN))
        else:
            out.append((a, b + SPAN))
    return out


def keyed(df: DataFrame, text_col: str, id_col: str, *keep: str) -> DataFrame:
    """texts() with the row's key: _row and _tag."""
    own = [F.col(id_col).cast("string"), F.col(text_col).cast("string")]
    return texts(df.withColumns({"_row": F.xxhash64(*own), "_tag": F.hash(*own)}), text_col, "_row", "_tag", *keep)


def read_rows(part) -> list:
    """((row, tag), text) of a batch."""
    return list(zip(zip(part.column("_row").to_pylist(), part.column("_tag").to_pylist()), text_column(part)))


def repeated_spans(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, tag, spans): for rows (by key) with repeated strings, ranges [first, last] of such strings' starts."""
    spark = df.sparkSession
    source = keyed(df, text_col, id_col)

    def first_round(batches):
        rows = (x for part in slices(batches) for x in read_rows(part))
        yield from map(unit_records, chunks(rows))

    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("n")).first()["n"]
    expected = max(1, size * 2 // REACH)
    share = min(1.0, STEP * sample_share(expected, spark))  # of rows, and of the pieces of long rows

    def pieces(batches):
        for part in slices(batches):
            for key, t in read_rows(part):
                if len(t) <= PIECE:
                    yield key, t
                    continue
                for base in range(0, len(t), PIECE):
                    if xxhash.xxh3_64_intdigest(b"%d %d" % (key[0], base)) < share * (1 << 64):
                        yield key, t[base : base + PIECE + SPAN]

    def some_units(batches):
        for cols in map(unit_records, chunks(pieces(batches))):
            yield [c[::STEP] for c in cols]

    chosen = source.where((F.octet_length("_text") > PIECE) | (F.pmod(F.xxhash64("_row", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))))
    hits, table = sorted_buckets(source, first_round, sampled(chosen, some_units, LEAD // 8 + 2), expected, scratch, LEAD)
    sure, other = F.when(F.col("full"), F.struct("first", "last")), F.when(~F.col("full"), F.struct("first", "last"))
    per_row = scratch.write(hits.groupBy("row", "tag").agg(F.collect_set(sure).alias("sure"), F.collect_set(other).alias("open")))
    scratch.drop(table)
    both = per_row.select("row", "tag", F.explode("sure").alias("s")).select("row", "tag", "s.first", "s.last")

    # second round: the strings of units that share only the leading bytes
    open_rows = per_row.where(F.size("open") > 0).select(F.col("row").alias("_row"), F.col("tag").alias("_tag"), "open")
    n = open_rows.agg(F.sum(F.expr("aggregate(open, 0L, (n, o) -> n + o.last - o.first + 1)")).alias("n")).first()["n"]
    if n:
        strings = scratch.write(source.join(open_rows.hint("shuffle_hash"), ["_row", "_tag"]))
        share = min(1.0, STEP * sample_share(n, spark))  # of spans

        def strings_of(batches, step=1):
            for part in slices(batches, rows=200):
                for (key, t), spans in zip(read_rows(part), part.column("open").to_pylist()):
                    yield from string_records(key, t, sorted((s["first"], s["last"]) for s in spans), step)

        some = F.filter("open", lambda o: F.pmod(F.xxhash64("_row", o["first"]), F.lit(1 << 20)) < int(share * (1 << 20)))
        sample = sampled(strings.withColumn("open", some).where(F.size("open") > 0), lambda batches: strings_of(batches, STEP), STRING_LEAD // 8 + 2)
        singles, table = sorted_buckets(strings, strings_of, sample, n, scratch, STRING_LEAD, part=False)
        scratch.drop(strings)
        both = both.union(singles.select("row", "tag", "first", "last"))
    spans = scratch.write(both.groupBy("row", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    scratch.drop(per_row, table)
    return spans


def with_spans(df: DataFrame, scratch: Scratch, text_col: str, id_col: str, *keep: str) -> DataFrame:
    """The kept columns, _text and spans (null: none) of each row; only spans are built into tables."""
    spans = repeated_spans(df, scratch, text_col, id_col)
    return keyed(df, text_col, id_col, *keep).join(spans.withColumnsRenamed({"row": "_row", "tag": "_tag"}).hint("shuffle_hash"), ["_row", "_tag"], "left").drop("_row", "_tag")


def mapped(source: DataFrame, keep: list[str], schema: str, each) -> DataFrame:
    """each(text, runs to remove) gives the values that the schema names."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    out = StructType([source.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(out)

    def run(batches):
        for part in slices(batches, rows=100):
            rows = [each(t, cover([(s["first"], s["last"]) for s in spans or ()])) for t, spans in zip(text_column(part), part.column("spans").to_pylist())]
            cols = [part.column(c).cast(arrow.field(i).type) for i, c in enumerate(keep)]
            values = list(zip(*rows)) if rows else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(v, type=arrow.field(len(keep) + i).type) for i, v in enumerate(values)]], schema=arrow)

    return source.mapInArrow(run, out)


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What stays, joined."""
    ends = [0, *[b for _, b in runs]]
    begins = [*[a for a, _ in runs], len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, begins))


def whole_letters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without code points that are only partly in them, so that what stays is UTF-8."""
    out = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def removed_runs(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (the id by default), n_bytes, runs (maximal removed byte ranges) and kept_bytes."""
    keep = [id_col] if keep is None else keep
    source = with_spans(df, scratch, text_col, id_col, *keep)
    return mapped(source, keep, "n_bytes long, runs array<struct<begin: long, end: long>>, kept_bytes binary", lambda t, runs: (len(t), [{"begin": a, "end": b} for a, b in runs], without(t, runs)))


def removal_digests(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id, n_bytes, n_removed, n_spans and kept_sha256: what removed_runs() gives, hashed where it is made."""
    source = with_spans(df, scratch, text_col, id_col, id_col)
    return mapped(source, [id_col], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda t, runs: (len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(t, runs)).hexdigest()))


def drop_repeats(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None) -> DataFrame:
    """All rows and columns of df; the text loses its repeated strings (whole code points only), and length_col counts what stays."""
    plain, name = neutral(df)
    text = name[text_col]
    keep = [c for c in plain.columns if c != text]
    source = with_spans(plain, scratch, text, name[id_col], *keep)
    done = mapped(source, keep, f"{text} string", lambda t, runs: (decoded(without(t, whole_letters(t, runs))),))
    if length_col:
        done = done.withColumn(name[length_col], F.length(text).cast(df.schema[length_col].dataType))
    return done.select(*plain.columns).toDF(*df.columns)
