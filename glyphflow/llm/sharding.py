"""Sharding by balanced label propagation, with DataFrame operations only.

Documents of equal text are linked. A group of more rows than a shard's share (there are at most as many as shards) is first
packed into whole shards, its rest into the smallest room that takes it; the rounds and cuts leave it there. Each other
document starts in the shard that a hash of its id names, among the rooms that are left. In each round, every group of
linked documents asks to move its smaller parts to the shard that holds most of it (of equal parts, one by a hash). A
shard's room is a capacity: what may come in is what is free plus what goes out in the same round, so full shards swap.
`flows` cuts the asked flows between shards to such ones; of each flow that share of the parts moves, a large part in
proportion, a small one whole or not at all by a hash. Members only move to larger parts, so the sum of squares of a
group's parts grows, the number of cut edges shrinks, and rounds end: when less than one linked document in SETTLED moves.
Then every shard holds at most its exact share: what is above by the luck of hashes leaves, smallest groups first, and
fills all gaps together with unlinked documents; what leaves of a group stays side by side, and the largest gaps take the
largest groups.

Law `rows`: shards' row counts differ by at most one. State is one row a group with its parts, so a group
of any size is one small row, links are never listed as pairs, and members that are alike aren't told apart until the
end. Groups of over a 1024th of all rows (at most 1024 of them) are dealt to their places in SALTS parts. A null text has
size 8 and is linked to empty ones; rows of equal ids and texts are interchangeable; very long texts are hashed whole.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

SHARDS, SALTS, SUB_BANDS = 24, 512, 16
#: Rounds end when less than one linked document in SETTLED moves. Each round makes parts grow, so they do; a warning tells
#: if so many rounds have not been enough. Parts of LARGE documents and more move in proportion.
SETTLED, ROUNDS, LARGE = 2000, 100, 64


def documents_table(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("gid"))


def packed(heavy: list, room: list[int]) -> dict[str, list[int]]:
    """Counts by shard of each group (gid, n), largest first; room becomes what is left in each shard."""
    out = {}
    for gid, n in heavy:
        counts = [0] * len(room)
        while n:
            enough = [s for s, r in enumerate(room) if r >= n]
            s = min(enough, key=lambda x: room[x]) if enough else max(range(len(room)), key=lambda x: room[x])
            counts[s] += (take := min(n, room[s]))
            room[s] -= take
            n -= take
        out[gid] = counts
    return out


def linked_groups(docs: DataFrame, shards: int, room: list[int] | None = None) -> DataFrame:
    """(gid, n, parts): groups of at least two, with the number c of members that start in each shard s, in proportion to room if given."""
    label = F.pmod(F.xxhash64("id", "size"), F.lit(shards)).cast("int")
    if room and sum(room):
        ends = F.array(*[F.lit(sum(room[: s + 1])).cast("long") for s in range(shards)])
        label = F.size(F.filter(ends, lambda e: e <= F.pmod(F.xxhash64("id", "size"), F.lit(sum(room)))))
    cells = docs.select("gid", label.alias("s")).groupBy("gid", "s").agg(F.count("*").alias("c"))
    return cells.groupBy("gid").agg(F.sum("c").alias("n"), F.collect_list(F.struct("c", "s")).alias("parts")).where("n > 1")


def loads(groups: DataFrame, shards: int) -> list[int]:
    found = {r["s"]: r["c"] for r in groups.select(F.explode("parts").alias("p")).groupBy("p.s").agg(F.sum("p.c").alias("c")).collect()}  # a row a shard
    return [found.get(s, 0) for s in range(shards)]


def flows(asked: list[list[int]], free: list[int]) -> list[list[float]]:
    """The largest shares of the asked flows, cut shard by shard, that bring no shard more than it has free and sends away."""
    n = range(len(free))
    flow = [[float(x) for x in row] for row in asked]
    for _ in range(1000):
        share = []
        for t in n:
            inflow, outflow = sum(flow[s][t] for s in n), sum(flow[t])
            share.append(1.0 if inflow <= 0 else min(1.0, max(0.0, free[t] + outflow) / inflow))
        if min(share) > 1 - 1e-6:
            break
        flow = [[x * share[t] for t, x in enumerate(row)] for row in flow]
    return flow


def propagate(groups: DataFrame, rooms: list[int], scratch: Scratch, shards: int = SHARDS) -> DataFrame:
    """Rounds of moves under the shards' rooms, until hardly any is made; groups is a written table, and goes."""
    is_open = [True] * shards
    for turn in range(ROUNDS):
        key = F.expr(f"transform(parts, p -> named_struct('c', p.c, 'tie', hash(gid, p.s, {turn}), 's', p.s))")
        open_shards = F.array(*[F.lit(x) for x in is_open])
        asked = groups.withColumn("spots", key).withColumn("to", F.array_max(F.filter("spots", lambda x: F.get(open_shards, x["s"]))))
        goes = F.transform("spots", lambda x: F.struct(x["c"].alias("c"), x["s"].alias("s"), F.when(F.col("to").isNotNull() & (x < F.col("to")), F.col("to.s")).otherwise(x["s"]).alias("t")))
        asked = asked.select("gid", "n", goes.alias("parts"))
        wanted, load = [[0] * shards for _ in range(shards)], [0] * shards
        for r in asked.select(F.explode("parts").alias("p")).groupBy("p.s", "p.t").agg(F.sum("p.c").alias("c")).collect():  # at most shards * shards rows
            load[r["s"]] += r["c"]
            if r["s"] != r["t"]:
                wanted[r["s"]][r["t"]] = r["c"]
        given = flows(wanted, [a - b for a, b in zip(rooms, load)])
        if sum(map(sum, given)) * SETTLED < max(1, sum(load)):
            return groups
        is_open = [not any(row[t] for row in wanted) or sum(row[t] for row in given) > 0.01 * sum(row[t] for row in wanted) for t in range(shards)]
        share = F.array(*[F.lit(g / w if w else 0.0) for a, b in zip(given, wanted) for g, w in zip(a, b)])
        part = F.expr(f"pmod(hash(gid, {turn}, 7), 1048576) / 1048576D")

        def moved(x):
            mine = F.get(share, x["s"] * shards + x["t"])
            return F.when(x["s"] == x["t"], F.lit(0).cast("long")).when(x["c"] >= LARGE, F.floor(x["c"] * mine)).otherwise(F.when(part < mine, x["c"]).otherwise(F.lit(0).cast("long")))

        left = asked.withColumn("parts", F.transform("parts", lambda x: F.struct(x["c"].alias("c"), x["s"].alias("s"), x["t"].alias("t"), moved(x).alias("m"))))
        target = F.filter("parts", lambda x: x["s"] != x["t"])
        left = left.withColumn("t", F.get(target, F.lit(0))["t"]).withColumn("come", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["m"]))
        grown = F.transform("parts", lambda x: F.struct((x["c"] - x["m"] + F.when(x["s"] == F.col("t"), F.col("come")).otherwise(0)).cast("long").alias("c"), x["s"].alias("s")))
        new = scratch.write(left.select("gid", "n", F.filter(grown, lambda x: x["c"] > 0).alias("parts")))
        scratch.drop(groups)
        groups = new
    warnings.warn(f"label propagation still moved documents after {ROUNDS} rounds", stacklevel=2)
    return groups


def running(df: DataFrame, bucket: str, cols: list[str]) -> DataFrame:
    """Of a table with one row a bucket (their number is bounded): the sums over all buckets before."""
    window = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return df.select(bucket, *[F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"{c}_before") for c in cols])


def assign(df: DataFrame, scratch: Scratch, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, size, crc, shard and slot for each row."""
    docs = scratch.write(documents_table(df, text_col, id_col))
    total = docs.count()
    buckets = min(1 << 15, max(256, -(-total // 2_000_000)))
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    found = docs.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > max(1, quota[0])).orderBy(F.desc("n"), "gid").collect()  # fewer than `shards` rows
    room = list(quota)
    heavy = packed([(r["gid"], r["n"]) for r in found], room)
    if heavy:
        big = docs.sparkSession.createDataFrame([(r["gid"], r["n"], [(c, s) for s, c in enumerate(heavy[r["gid"]]) if c]) for r in found], "gid string, n long, parts array<struct<c: long, s: int>>")
        others = linked_groups(docs.join(F.broadcast(big.select("gid")), "gid", "left_anti"), shards, room)
        groups = scratch.write(propagate(scratch.write(others), room, scratch, shards).unionByName(big))
    else:
        groups = propagate(scratch.write(linked_groups(docs, shards)), room, scratch, shards)
    load = loads(groups, shards)
    kept = [min(a, b) for a, b in zip(load, quota)]
    gaps = [b - a for a, b in zip(kept, quota)]

    # where each part of a group starts in its shard
    c = [f"c{s}" for s in range(shards)]
    # in each shard the packed groups come first, then groups of over 256 by size, then all others
    by_size = F.when(F.col("n") > max(1, quota[0]), -2000).when(F.col("n") > 256, -(F.floor(F.log2("n")) * SUB_BANDS + F.pmod(F.hash("gid"), F.lit(SUB_BANDS))))
    bucket = F.coalesce(by_size, F.pmod(F.xxhash64("gid"), F.lit(buckets))).cast("int")
    counts = F.map_from_entries(F.transform("parts", lambda p: F.struct(p["s"], p["c"])))
    wide = groups.withColumn("m", counts).select("gid", "n", *[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0)).cast("long").alias(x) for s, x in enumerate(c)], bucket.alias("bucket"))
    ahead = running(wide.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in c]), "bucket", c)  # at most `buckets` and 64 * SUB_BANDS rows
    window = W.partitionBy("bucket").orderBy("gid").rowsBetween(W.unboundedPreceding, -1)
    inner = wide.select("gid", "n", "bucket", *c, *[F.coalesce(F.sum(x).over(window), F.lit(0)).alias(f"{x}_in") for x in c]).join(F.broadcast(ahead), "bucket")
    parts, start = [], F.lit(0).cast("long")
    for s, x in enumerate(c):
        parts.append(F.struct(F.lit(s).alias("shard"), start.alias("start"), F.col(x).alias("size"), (F.col(f"{x}_in") + F.col(f"{x}_before")).alias("pos")))
        start = start + F.col(x)
    cells = scratch.write(inner.select("gid", "n", F.filter(F.array(*parts), lambda p: p["size"] > 0).alias("cells")))
    scratch.drop(groups)

    # a member's number in its group, the large groups in parts
    limit = max(256, total // 1024)
    large = cells.where(F.col("n") > limit)  # at most 1024 rows
    turns = large.select("gid", F.row_number().over(W.orderBy(F.desc("n"), "gid")).alias("large"))
    salted = docs.join(F.broadcast(turns), "gid", "left").withColumn("salt", F.when(F.col("large").isNotNull(), F.pmod(F.xxhash64("id", "size", "crc"), F.lit(SALTS)).cast("int")).otherwise(0))
    per_salt = salted.where("salt >= 0").join(F.broadcast(large.select("gid")), "gid").groupBy("gid", "salt").agg(F.count("*").alias("c"))  # at most 1024 * SALTS rows
    ahead = per_salt.select("gid", "salt", F.coalesce(F.sum("c").over(W.partitionBy("gid").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    small = cells.where(F.col("n") <= limit).select("gid", F.lit(0).alias("salt"), "cells")
    rank = F.row_number().over(W.partitionBy("gid", "salt").orderBy("id", "size")) - 1
    ranked = salted.join(small, ["gid", "salt"], "left").withColumn("rank", rank)
    ranked = ranked.join(F.broadcast(large.select("gid", F.col("cells").alias("large_cells"))), "gid", "left").join(F.broadcast(ahead), ["gid", "salt"], "left")
    place = F.expr("filter(coalesce(large_cells, cells), p -> rank + coalesce(ahead, 0L) >= p.start and rank + coalesce(ahead, 0L) < p.start + p.size)[0]")
    limits = F.array(*[F.lit(k).cast("long") for k in kept])
    placed = ranked.withColumn("p", place).withColumn("slot", F.expr("p.pos + rank + coalesce(ahead, 0L) - p.start"))
    fits = F.col("p").isNotNull() & (F.col("slot") < limits[F.col("p.shard")])
    placed = scratch.write(placed.select("id", "size", "crc", F.when(fits, F.col("p.shard")).alias("shard"), F.when(fits, F.col("slot")).alias("slot"), F.xxhash64("gid").alias("g"), F.when(F.col("large").isNotNull(), (F.col("large") - 2048) * SALTS + F.col("salt")).otherwise(F.pmod(F.xxhash64("gid"), F.lit(buckets))).cast("int").alias("bucket")))

    # all others fill the gaps, largest gap first, each group side by side, the large groups (at most 1024 * SALTS buckets) first
    loose = placed.where("shard is null")
    ahead = running(loose.groupBy("bucket").agg(F.count("*").alias("c")), "bucket", ["c"])
    turn = F.row_number().over(W.partitionBy("bucket").orderBy("g", "id", "crc")) - 1
    loose = loose.withColumn("turn", turn).join(F.broadcast(ahead), "bucket").withColumn("turn", F.col("turn") + F.col("c_before"))
    order = sorted(range(shards), key=lambda s: -gaps[s])
    ends = [sum(gaps[x] for x in order[: order.index(s) + 1]) for s in range(shards)]
    into = reduce(lambda rest, s: F.when(F.col("turn") < ends[s], F.lit(s)).otherwise(rest), order[::-1], F.lit(None).cast("int"))
    base = F.array(*[F.lit(kept[s] - (ends[s] - gaps[s])).cast("long") for s in range(shards)])
    loose = loose.withColumn("shard", into).withColumn("slot", F.col("turn") + base[F.col("shard")])
    out = ["id", "size", "crc", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")]
    return placed.where("shard is not null").select(*out).unionByName(loose.select(*out)).withColumnRenamed("id", id_col)
