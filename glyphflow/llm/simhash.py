"""SimHash near-duplicates: BK-trees over fingerprints, one for each shard.

Fingerprints that differ in at most RADIUS = 3 of 64 bits agree in one of four blocks of 16 bits, so each distinct
fingerprint goes to the four shards that its blocks name; with very many fingerprints also one of four 12-bit parts of the
other 48 bits is fixed, which gives sixteen smaller shards. A shard's tree has children by integer Hamming distance to the
parent, and a search follows only edges within the radius. A shard of more than CELL fingerprints is cut into trees of at
most CELL, and each tree goes (is sent) to the shard's other parts, so no task holds an unbounded shard. Links found in a
cell leave as its spanning forest: the classes stay, pairs do not multiply. Classes meet by min-label hooking over
distinct fingerprints with pointer jumping, in written tables.

Trees are sent by shuffles, not by the driver: a driver that broadcasts every shard's tree would hold the fingerprints of
all documents, which grow with the corpus.

Equal fingerprints are one node, so groups of copies cost nothing. No words: fingerprint zero, linked like any other.
Null texts have no words. Repeated rows share a class, and so do rows with the same text and no id. A very long text is
hashed 32,768 shingles at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_words, map_texts, neutral

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints in one tree at most; distinct fingerprints from which sixteen tables are used.
CELL, FINE_FROM = 4096, 1 << 24


def fingerprint(text: bytes) -> int:
    """64 bits, unsigned; a bit is 1 if set in over half the shingles' hashes, repeats included."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    counts = np.zeros(64, dtype=np.int64)
    begin, end = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + (1 << 15)], end[at : at + (1 << 15)])], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 128), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.where(2 * counts > n)[0].tolist()))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit column to the kept columns; map-only."""

    def each(found, _):
        memo = {}
        rows = []
        for t in found:
            if t not in memo:
                memo[t] = signed(fingerprint(t))
            rows.append((memo[t],))
        return rows

    return map_texts(df, text_col, list(df.columns) if keep is None else keep, f"{name} long", each)


class BKTree:
    """Fingerprints as nodes; a child hangs at its integer distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, x: int) -> list[int]:
        """Nodes within the radius; children at a distance out of reach aren't visited."""
        if not self.values:
            return []
        out, stack, values, children = [], [0], self.values, self.children
        while stack:
            at = stack.pop()
            d = (x ^ values[at]).bit_count()
            if d <= RADIUS:
                out.append(at)
            kids = children[at]
            if kids:
                if len(kids) > 2 * RADIUS + 1:
                    stack += [kids[k] for k in range(d - RADIUS, d + RADIUS + 1) if k in kids]
                else:
                    stack += [node for k, node in kids.items() if -RADIUS <= k - d <= RADIUS]
        return out

    def add(self, x: int) -> None:
        node = len(self.values)
        self.values.append(x)
        self.children.append({})
        if node:
            at = 0
            while True:
                d = (x ^ self.values[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = node
                    return
                at = nxt


def cell_links(members: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spanning forest of the links in a cell; members: (role, fingerprint), role 0 for the tree and queries, 1 tree only, 2 queries only."""
    tree, values, parent = BKTree(), [], {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for role, fp in members:
        x = fp & mask
        parent.setdefault(x, x)
        if role != 1:
            for node in tree.search(x):
                a, b = find(x), find(tree.values[node])
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if role != 2:
            tree.add(x)
            values.append(x)
    return [(signed(x), signed(r)) for x in parent if (r := find(x)) != x]


def shard_keys(fine: bool):
    """Column expression: the keys of a fingerprint's shards."""
    fp = F.col("fp")
    part = lambda at, size: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1))
    keys = []
    for b in range(4):
        block = part(16 * b, 16)
        if not fine:
            keys.append(block + F.lit(b << 16))
            continue
        # the other 48 bits, closed up
        low = fp.bitwiseAND(F.lit((1 << (16 * b)) - 1)) if b else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * b + 16), 16 * b) if b < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for k in range(4):
            keys.append(F.shiftrightunsigned(rest, 12 * k).bitwiseAND(F.lit(4095)) + F.shiftleft(block, 12) + F.lit((4 * b + k) << 28))
    return F.explode(F.array(*keys))


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span all classes; both orders don't occur."""
    fine = distinct.count() >= FINE_FROM
    placed = distinct.select("fp", shard_keys(fine).alias("key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    large = scratch.write(sizes.where(F.col("n") > CELL))
    # shards up to a tree are one cell (first 0, second 0); of larger ones, each pair of parts (first <= second) is a cell
    spread = large.select("key", F.ceil(F.col("n") / F.lit(CELL)).cast("int").alias("parts"))
    joined = placed.join(spread, "key", "left") if large.head(1) else placed.withColumn("parts", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = joined.withColumn("own", own).select(
        "key", "fp", F.explode(F.when(F.col("parts").isNull(), F.expr("array(named_struct('i', 0, 'j', 0, 'role', 0))")).otherwise(F.expr("transform(sequence(0, parts - 1), p -> named_struct('i', least(p, own), 'j', greatest(p, own), 'role', case when p = own then 0 when own < p then 1 else 2 end))"))).alias("cell")
    ).select("key", "cell.i", "cell.j", "cell.role", "fp")

    def run(batches):
        last, members, out = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", "role", "fp")]
            for key, i, j, role, fp in zip(*cols):
                if (key, i, j) != last:
                    if len(members) > 1:
                        out += cell_links(members)
                    last, members = (key, i, j), []
                members.append((role, fp))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
                out = []
        if len(members) > 1:
            out += cell_links(members)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.expr("case role when 1 then 0 when 0 then 1 else 2 end"), "fp")
    found = scratch.write(dealt.mapInArrow(run, "a long, b long").distinct())
    scratch.drop(large)
    return found


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b); a root is one of its class.

    Each round, a node hooks to its smallest neighbour if that is smaller, trees are halved twice by pointer jumping, and
    edges move to their ends' trees; the live nodes at least halve about every round. Tables are written each round, as
    lineage would grow else; nothing but a row count reaches the driver.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = scratch.write(both(edges).select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    live = edges
    while live.head(1):
        hook = both(live).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p"))
        hook = scratch.write(hook)
        up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        once = hook.join(up, "p").select("x", F.col("pp").alias("p"))
        jump = scratch.write(once.join(up, "p").select("x", F.col("pp").alias("p")))
        to = lambda c: jump.select(F.col("x").alias(c), F.col("p").alias(f"{c}_p"))
        moved = live.join(to("a"), "a").join(to("b"), "b").where("a_p <> b_p").select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b")).distinct()
        new_live = scratch.write(moved)
        new_nodes = scratch.write(nodes.join(jump.select(F.col("x").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        scratch.drop(hook, jump, nodes, *([live] if live is not edges else []))
        live, nodes = new_live, new_nodes
    return nodes


def classes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, leader) for each distinct fingerprint of prints (id, row, fp): the struct (none, id, row) of its class's first row, that is
    the one with the smallest id and of those the smallest row; rows without an id come last."""
    firsts = scratch.write(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")))
    edges = links(firsts.select("fp"), scratch)
    roots = components(edges, scratch)
    scratch.drop(edges)
    member = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = member.groupBy("root").agg(F.min("first").alias("leader"))
    found = scratch.write(member.join(best, "root").select("fp", "leader"))
    scratch.drop(firsts, roots)
    return found


def near_duplicates(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, fp and component_id (the smallest id reachable; null where no row of the class has one) for each row."""
    prints = scratch.write(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"]))
    found = classes(prints.withColumn("row", F.lit(0).cast("long")), scratch)
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "fp", F.col("leader.id").alias("component_id"))


def keep_leaders(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Exactly one row of each class, all columns: that with the smallest id; of equal ids one, rows without an id only where all are.

    Rows are numbered in a written table beside their fingerprints, so texts are read once and shuffled once, and rows that
    share an id but not a class stay apart.
    """
    plain, name = neutral(df)
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    printed = scratch.write(fingerprints(numbered, name[text_col], numbered.columns))
    found = classes(printed.select(F.col(name[id_col]).alias("id"), "row", "fp"), scratch)
    leaders = scratch.write(found.select(F.col("leader.row").alias("row")).distinct())
    scratch.drop(found)
    return printed.join(leaders.hint("shuffle_hash"), "row", "left_semi").select(*plain.columns).toDF(*df.columns)
