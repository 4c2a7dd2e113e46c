"""LM scoring with Brown class-based bigrams.

Exchange clustering moves the most frequent words (the core) one at a time to the class that most raises the likelihood of the
class bigrams, over bigram counts of all training documents. Each other training word is then added by one incremental step: to
the class that most raises that likelihood, given the classes of the core words (or the document's start and end) that stand
next to its occurrences, other words skipped. Core and classes grow with the distinct training words; those that are not in
the head stay in tables. Start and end have classes of their own, and only words that no training document has are in the
open class. A word's log probability is that of its class after the previous word's class, smoothed by the class's own
share, plus that of the word within its class, (c + 0.1) over the class's count with 0.1 added for each of its words. An unseen
word has its unigram probability after each class. So the probabilities after each class sum to one.

All counts cover all training documents (crc32 of the id as text, mod 10, is not 0) and are combined before they are
shuffled. The head, at most HEAD of the most frequent words of at most WORD_BYTES bytes, goes to the workers; texts become
numbers of head words once, beside their other words, and all later steps read those. Other words are joined on the word,
and what stands beside a word travels as one packed value a task. A null text is empty: its end is its only token. A null
id counts as the text ''. Words of equal counts are taken in their own order. A very long text is one row of numbers.
Repeated rows are scored each; with no training rows all counts are zero.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, binaries, bound_batches, gathered, slices, texts, word_lists

HEAD, CLUSTERED, CLASSES, SWEEPS, WORD_BYTES = 1 << 18, 2048, 64, 4, 64
#: CLUSTERED and CLASSES are the least: the core grows with the square root of the distinct words, the classes with the cube root.
#: Weight of a class's own share in the transitions from each class; the discount and entries of a partial count.
ALPHA, ADD, PARTIAL = 2.0, 0.1, 400_000


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def held_out_column(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(training: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all training texts; each task sends a word once for every PARTIAL entries of its table."""

    def run(batches):
        held, rows = [], 0

        def combined():
            t = pa.TableGroupBy(pa.concat_tables(held), "word", use_threads=False).aggregate([("n", "sum")])
            return t.rename_columns(["word" if c == "word" else "n" for c in t.column_names]).select(["word", "n"])

        for part in slices(batches):
            found = pc.value_counts(word_lists(part)[0])
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            rows += len(found)
            if rows >= 3 * PARTIAL:
                held = [combined()]
                rows = held[0].num_rows
                if rows >= PARTIAL:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from combined().to_batches(max_chunksize=50_000)

    return texts(training, text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def head_cut(counts: DataFrame, words: int) -> int:
    """The least count whose words, with all that are more frequent, number at most `words`; counts are binned eight to a power of two."""
    found = counts.where(F.octet_length("word") <= WORD_BYTES).groupBy(F.floor(8 * F.log2("c")).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    cut, total = 1 << 62, 0
    for r in sorted(found.collect(), key=lambda r: -r["bin"]):  # at most 512 rows
        total += r["n"]
        if total > words:
            break
        cut = r["least"]
    return cut


def numbered(df: DataFrame, words: list[bytes], counts: np.ndarray, ends: int, text_col: str, id_col: str) -> DataFrame:
    """For each row _row, id, held_out, n_tokens, known and logs (of head words and the end), path and rare.

    path: head words' numbers, and -1, -2, ... for other words, which stand in rare with their numbers in the text.
    """
    shared = df.sparkSession.sparkContext.broadcast((pa.array(words, pa.binary()), np.log10(counts + ADD)))  # the head
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), held_out_column(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    schema = StructType([*rows.schema.fields[:3], *StructType.fromDDL("n_tokens long, known long, logs double, path binary, rare array<struct<word: binary, tf: long>>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        head, log = shared.value
        for part in gathered(batches, 4 << 20):
            n = part.num_rows
            found, begin = word_lists(part)
            ids = pc.fill_null(pc.index_in(found, value_set=head), -1).to_numpy().copy()
            row = np.repeat(np.arange(n), np.diff(begin))
            inside, other = ids >= 0, np.flatnonzero(ids < 0)
            known = np.bincount(row[inside], minlength=n) + (ends > 0)
            logs = np.bincount(row[inside], log[ids[inside]], n) + math.log10(ends + ADD)
            rare = found.take(pa.array(other)).dictionary_encode()
            size = max(1, len(rare.dictionary))
            pair, at, tf = np.unique(row[other] * size + rare.indices.to_numpy(), return_inverse=True, return_counts=True)
            cuts = np.searchsorted(pair, np.arange(n + 1) * size)
            ids[other] = cuts[row[other]] - 1 - at
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([rare.dictionary.take(pa.array(pair % size)), pa.array(tf, pa.int64())], names=["word", "tf"]))
            cols = [pa.array(np.diff(begin) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), binaries(ids.astype(np.int32), begin), lists]
            yield pa.RecordBatch.from_arrays([*[part.column(i).cast(arrow.field(i).type) for i in range(3)], *[c.cast(arrow.field(3 + i).type) for i, c in enumerate(cols)]], schema=arrow)

    bound_batches(df.sparkSession)
    return rows.mapInArrow(run, schema)


#: Numbers of a text's start and end in its path.
START, END = 1 << 30, (1 << 30) + 1


def joined_paths(batch) -> np.ndarray:
    """The paths of a batch one after another, each with its start and end."""
    out = []
    for p in batch.column("path").to_pylist():
        out += [(START,), np.frombuffer(p, np.int32), (END,)]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def bigram_counts(lines: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, next, n) of adjacent pairs among the core words (0 to k - 1), any other word (k), start (k + 1) and end (k + 2)."""
    size = k + 3

    def run(batches):
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            a = joined_paths(batch)
            a = np.where(a >= START, a - START + k + 1, np.where((a >= 0) & (a < k), a, k))
            new, c = np.unique((a[:-1] * size + a[1:])[a[:-1] != k + 2], return_counts=True)
            codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, c]), len(codes)).astype(np.int64)
            if len(codes) >= PARTIAL:
                yield out()
                codes, n = codes[:0], n[:0]
        yield out()

    found = lines.select("path").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    code = found.column("code").to_numpy()
    return code // size, code % size, found.column("n").to_numpy().astype(float)


def gains(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(first: np.ndarray, then: np.ndarray, n: np.ndarray, k: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes 0 to classes - 1 of the k core words; the last three symbols keep classes of their own after them."""
    size, m, f = k + 3, classes + 3, gains
    own = np.array([i % classes for i in range(k)] + [classes, classes + 1, classes + 2])
    if k == 0:
        return own
    right, left, grid = np.zeros((size, m)), np.zeros((size, m)), np.zeros((m, m))  # of each symbol: counts with the next and the previous class
    np.add.at(right, (first, own[then]), n)
    np.add.at(left, (then, own[first]), n)
    np.add.at(grid, (own[first], own[then]), n)
    out, into = np.bincount(first, n, size), np.bincount(then, n, size)
    same = np.bincount(first[first == then], n[first == then], size)
    back = np.argsort(then, kind="stable")  # pairs come sorted by their first
    rows, cols = np.searchsorted(first, np.arange(size + 1)), np.searchsorted(then[back], np.arange(size + 1))
    d = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            a, self_n = own[w], same[w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= self_n
            l[a] -= self_n
            # without w
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= self_n
            row, col = grid.sum(1), grid.sum(0)
            g = grid[:classes]
            # gain of each class: its line, its column, their crossing once
            gain = (f(g + r) - f(g)).sum(1) + (f(grid[:, :classes] + l[:, None]) - f(grid[:, :classes])).sum(0)
            cross = grid[d, d]
            gain += f(cross + r[:classes] + l[:classes] + self_n) - f(cross + r[:classes]) - f(cross + l[:classes]) + f(cross)
            gain -= f(row[:classes] + out[w]) - f(row[:classes]) + f(col[:classes] + into[w]) - f(col[:classes])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += self_n
            if b != a:
                own[w] = b
                moved += 1
                before, after = back[cols[w] : cols[w + 1]], slice(rows[w], rows[w + 1])
                right[first[before], a] -= n[before]
                right[first[before], b] += n[before]
                left[then[after], a] -= n[after]
                left[then[after], b] += n[after]
        if not moved:
            break
    return own


#: What stands beside a word: slot is the class of the nearest core word (or end) after it, or m + that before it.
SLOTS = np.dtype([("slot", "<u2"), ("n", "<u8")])


def neighbour_counts(lines: DataFrame, words: list[bytes], core: np.ndarray, m: int) -> DataFrame:
    """(word, slots) of all words that are not in the core: counts by SLOTS, packed; a word comes once for every flush of a task."""
    shared = lines.sparkSession.sparkContext.broadcast((pa.array(words, pa.binary()), core))  # the head, and the core's classes

    def run(batches):
        head, own = shared.value
        k, size = len(own), len(head)
        word, slot, rare, n_rare = [], [], [], 0  # numbers from the head's size up stand for entries of rare

        def out():
            found = pa.concat_arrays([r.cast(pa.binary()) for r in rare] or [pa.array([], pa.binary())]).dictionary_encode()
            w = np.concatenate(word).astype(np.int64)
            word.clear()
            beyond = np.flatnonzero(w >= size)
            w[beyond] = size + found.indices.to_numpy()[w[beyond] - size]
            code, n = np.unique(w * (2 * m) + np.concatenate(slot), return_counts=True)
            w = code // (2 * m)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])), len(code))
            packed = np.empty(len(code), SLOTS)
            packed["slot"], packed["n"] = code % (2 * m), n
            names = pa.concat_arrays([head, found.dictionary]).take(pa.array(w[cuts[:-1]]))
            yield from pa.table({"word": names, "slots": binaries(packed, cuts)}).to_batches(max_chunksize=20_000)

        for batch in batches:
            a = joined_paths(batch)
            other = np.flatnonzero(a < 0)
            if len(other):
                lists = batch.column("rare")
                begin = lists.offsets.to_numpy()
                a[other] = size + n_rare + (begin - begin[0])[np.cumsum(a == START)[other] - 1] - 1 - a[other]
                rare.append(lists.flatten().field("word"))
                n_rare += len(rare[-1])
            inner = (a >= k) & (a < START)
            klass = np.where(a >= START, a - START + m - 2, own[np.minimum(a, k - 1)] if k else 0)
            at, where = np.arange(len(a)), np.flatnonzero(inner)
            if len(where):
                before = np.maximum.accumulate(np.where(inner, 0, at))[where]
                after = np.minimum.accumulate(np.where(inner, len(a) - 1, at)[::-1])[::-1][where]
                word += [a[where].astype(np.int32)] * 2
                slot += [klass[after].astype(np.uint16), (m + klass[before]).astype(np.uint16)]
            if n_rare >= PARTIAL or sum(map(len, word)) >= 4 * PARTIAL:
                yield from out()
                word, slot, rare, n_rare = [], [], [], 0
                pa.default_memory_pool().release_unused()
        if word:
            yield from out()
            pa.default_memory_pool().release_unused()

    return lines.select("path", F.transform("rare", lambda x: F.struct(x["word"].alias("word"))).alias("rare")).mapInArrow(run, "word binary, slots binary")


class NeighbourClasses:
    """The class that most raises the likelihood, for words by their neighbours' classes; grid: the core's class bigrams."""

    SMALL = 32

    def __init__(self, grid: np.ndarray, classes: int):
        self.classes, self.m = classes, classes + 3
        grid = grid.copy()
        grid[classes], grid[:, classes] = 0, 0
        self.g = np.vstack([grid[:classes].T, grid[:, :classes]])  # of each slot: counts with each class
        self.fg, self.row, self.col, self.cross = gains(self.g), grid.sum(1)[:classes], grid.sum(0)[:classes], grid[np.arange(classes), np.arange(classes)]
        self.rise = np.stack([gains(self.g + x) - self.fg for x in range(self.SMALL + 1)])  # by count, slot and class
        self.once = np.full(self.m * self.m, -1, dtype=np.int64)  # by the slots of words that occur once

    def own(self, starts: np.ndarray, slot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, class) of words, whose slots begin at starts, come in order, and count n."""
        ends = np.append(starts[1:], len(slot))
        of = np.repeat(np.arange(len(starts)), ends - starts)
        total = np.bincount(of, np.where(slot < self.m, n, 0), len(starts)).astype(np.int64)  # one slot after and one before each occurrence
        klass = np.empty(len(starts), np.int64)
        single = np.flatnonzero((total == 1) & (ends - starts == 2))
        sign = slot[starts[single]] * self.m + slot[starts[single] + 1] - self.m
        first = np.unique(sign[self.once[sign] < 0], return_index=True)[0]
        if len(first):
            pairs = np.column_stack([first // self.m, first % self.m + self.m]).ravel()
            self.once[first] = self.best(np.arange(len(first)) * 2, pairs, np.ones(len(pairs)), np.ones(len(first), np.int64))
        klass[single] = self.once[sign]
        more = np.ones(len(starts), bool)
        more[single] = False
        rest = np.flatnonzero(more)
        if len(rest):
            take = np.flatnonzero(more[of])
            sizes = (ends - starts)[rest]
            klass[rest] = self.best(np.cumsum(sizes) - sizes, slot[take], n[take], total[rest])
        return total, klass

    def best(self, starts: np.ndarray, slot: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        out, f, m = np.empty(len(starts), np.int64), gains, self.m
        for a in range(0, len(starts), 512):
            b = min(a + 512, len(starts))
            p, q = starts[a], starts[b] if b < len(starts) else len(slot)
            s, x = slot[p:q], n[p:q].astype(float)
            o = np.repeat(np.arange(b - a), np.diff(np.append(starts[a:b], q)))
            rise = self.rise[np.minimum(x, self.SMALL).astype(np.int64), s]
            if len(large := np.flatnonzero(x > self.SMALL)):
                rise[large] = f(self.g[s[large]] + x[large][:, None]) - self.fg[s[large]]
            gain = np.add.reduceat(rise, starts[a:b] - p, axis=0)
            r, l = np.zeros((b - a, m)), np.zeros((b - a, m))
            after = s < m
            r[o[after], s[after]] = x[after]
            l[o[~after], s[~after] - m] = x[~after]
            r, l = r[:, : self.classes], l[:, : self.classes]
            k = np.nonzero((r > 0) & (l > 0))
            y = self.cross[k[1]]
            gain[k] += f(y + r[k] + l[k]) - f(y + r[k]) - f(y + l[k]) + f(y)
            kinds, which = np.unique(total[a:b], return_inverse=True)
            t = kinds[:, None]
            gain -= (f(self.row + t) - f(self.row) + f(self.col + t) - f(self.col))[which]
            gain[:, self.row + self.col == 0] = -np.inf  # a class without core words would take in words of all kinds at once
            out[a:b] = gain.argmax(1)
        return out


def added_classes(sent: DataFrame, grid: np.ndarray, classes: int) -> DataFrame:
    """(word, c, klass): the class that each word raises the likelihood most in, given its neighbours' classes.

    A word's packed counts come one after another in a sorted partition and are added up as they come.
    """
    shared = sent.sparkSession.sparkContext.broadcast(grid)  # class by class

    def run(batches):
        model = NeighbourClasses(shared.value, classes)
        slots = 2 * model.m
        held, rows = [], 0

        def settle(last: bool):
            """Classes of the words that have come, but of the last one's only at the end; its counts stay, added up."""
            nonlocal held, rows
            words = pa.concat_arrays([h.column("word").cast(pa.binary()) for h in held])
            blobs = pa.concat_arrays([h.column("slots").cast(pa.binary()) for h in held])
            new = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
            cuts = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1)
            flat = np.frombuffer(blobs.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].view(SLOTS)
            of = np.repeat(np.cumsum(new) - 1, np.diff(cuts) // SLOTS.itemsize)
            code, at = np.unique(of * slots + flat["slot"], return_inverse=True)
            n = np.bincount(at, flat["n"], len(code)).astype(np.int64)
            of, slot = code // slots, code % slots
            names = words.take(pa.array(np.flatnonzero(new)))
            done = len(names) - (not last)
            held, rows = [], 0
            if not last:
                mine = of == done
                kept = np.empty(int(mine.sum()), SLOTS)
                kept["slot"], kept["n"] = slot[mine], n[mine]
                held, rows = [pa.RecordBatch.from_pydict({"word": names.slice(done), "slots": pa.array([kept.tobytes()], pa.binary())})], 1
                of, slot, n = of[~mine], slot[~mine], n[~mine]
            if done:
                total, klass = model.own(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), slot, n)
                yield pa.RecordBatch.from_pydict({"word": names.slice(0, done), "c": pa.array(total, pa.int64()), "klass": pa.array(klass, pa.int32())})

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 10_000:
                yield from settle(False)
        if rows:
            yield from settle(True)

    return sent.repartition(F.col("word")).sortWithinPartitions("word").mapInArrow(run, "word binary, c long, klass int")


class ClassModel:
    """Counts and classes of the head, and log10 factors: score = sum of log10(c + 0.1) + sum of factor[previous class, class]."""

    def __init__(self, classes: int, total: int, distinct: int, ends: int):
        self.total, self.distinct, self.ends, self.classes = total, distinct, ends, classes
        self.counts: dict[bytes, int] = {}
        self.klass: dict[bytes, int] = {}
        self.open, self.start, self.end = classes, classes + 1, classes + 2
        self.log_mass = math.log10(total + ADD * (distinct + 1))

    def settle(self, grid: np.ndarray, mass: np.ndarray) -> None:
        """The factors by the class bigrams, and each class's count with ADD for each of its words."""
        if not self.ends:  # no training rows: one unigram for all
            self.end = self.open
            self.factor = np.full(grid.shape, -self.log_mass)
            return
        mass = mass.copy()
        mass[self.end], mass[self.open] = self.ends + ADD, 0.0
        unseen = ADD / (mass.sum() + ADD)
        transition = (1 - unseen) * (grid + ALPHA * mass / mass.sum()) / (grid.sum(1, keepdims=True) + ALPHA)
        transition[:, self.open], mass[self.open] = unseen, ADD
        with np.errstate(divide="ignore"):
            self.factor = np.where(mass > 0, np.log10(np.maximum(transition, 1e-300)) - np.log10(np.maximum(mass, 1e-300)), -self.log_mass)


def settled_paths(lines: DataFrame, words: list[bytes], model: ClassModel, table: DataFrame) -> DataFrame:
    """id, held_out, n_tokens, n_known, logs and the classes of all tokens from start to end (path), for each row of numbered()."""
    rare = lines.select("_row", F.posexplode("rare").alias("i", "x")).select("_row", "i", "x.word", "x.tf").join(table, "word", "left")
    c = F.coalesce("c", F.lit(0))
    tails = rare.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("klass", F.lit(model.open)).alias("klass")))).alias("found"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10(c + F.lit(ADD))).alias("tail"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    whole = lines.drop("rare").join(tails, "_row", "left").select("id", "held_out", "n_tokens", (F.col("known") + zero("more")).cast("long").alias("n_known"), (F.col("logs") + zero("tail")).alias("logs"), "path", F.col("found.klass").alias("found"))
    schema = whole.drop("found").schema
    arrow = to_arrow_schema(schema)
    own = np.array([model.klass.get(w, model.open) for w in words] or [model.open], dtype=np.int16)
    shared = lines.sparkSession.sparkContext.broadcast(own)  # the head

    def run(batches):
        for b in batches:
            out = []
            for path, found in zip(b.column("path").to_pylist(), b.column("found")):
                a = np.frombuffer(path, np.int32)
                k = shared.value[np.maximum(a, 0)]
                if found.is_valid:
                    rare = np.flatnonzero(a < 0)
                    k[rare] = found.values.to_numpy()[-1 - a[rare]]
                out.append(np.concatenate([[model.start], k, [model.end]]).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) if f.name != "path" else pa.array(out, f.type) for f in arrow], schema=arrow)

    return whole.mapInArrow(run, schema)


def class_bigrams(rows: DataFrame, m: int) -> np.ndarray:
    """How often each class follows each in the rows' paths; at most m ** 2 rows a task leave it."""

    def run(batches):
        total = np.zeros(m * m, np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b.column("path").to_pylist()), np.int16).astype(np.int64)
            total += np.bincount((x[:-1] * m + x[1:])[x[:-1] != m - 1], minlength=m * m)  # no class follows an end
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int64()), "n": pa.array(total[code], pa.int64())})

    found = rows.select("path").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m * m)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(m, m)


def fit(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> tuple[ClassModel, DataFrame, DataFrame]:
    """The model, the written table of all training words (word, c, klass), and the rows' paths."""
    training = df.where(~held_out_column(id_col))
    counts = scratch.write(word_counts(training, text_col))
    found = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    k, classes = max(CLUSTERED, math.isqrt(found["v"])), max(CLASSES, round(found["v"] ** (1 / 3)))
    m = classes + 3
    cut = head_cut(counts, max(HEAD, k))
    head = sorted(((-c, bytes(w)) for w, c in counts.where((F.col("c") >= cut) & (F.octet_length("word") <= WORD_BYTES)).select("word", "c").toArrow().to_pandas().itertuples(index=False)))
    scratch.drop(counts)
    words = [w for _, w in head]
    lines = scratch.write(numbered(df, words, np.array([-c for c, _ in head], dtype=float), ends, text_col, id_col))
    train_lines = lines.where("not held_out")
    k = min(k, len(words))
    first, then, n = bigram_counts(train_lines, k)
    own = exchange(first, then, n, k, classes)
    grid = np.zeros((m, m))
    np.add.at(grid, (own[first], own[then]), n)
    classed = df.sparkSession.createDataFrame([(bytearray(w), -c, int(own[i])) for i, (c, w) in enumerate(head[:k])], "word binary, c long, klass int")
    table = scratch.write(added_classes(neighbour_counts(train_lines, words, own[:k], m), grid, classes).unionByName(classed))
    model = ClassModel(classes, found["n"] + ends, found["v"] + bool(ends), ends)
    model.counts = {w: -c for c, w in head}
    known = table.where((F.col("c") >= cut) & (F.octet_length("word") <= WORD_BYTES)).select("word", "klass").toArrow()  # the head
    model.klass = dict(zip(map(bytes, known.column("word").to_pylist()), known.column("klass").to_pylist()))
    rows = scratch.write(settled_paths(lines, words, model, table))
    scratch.drop(lines)
    mass = np.zeros(m)
    for r in table.groupBy("klass").agg((F.sum("c") + F.lit(ADD) * F.count("*")).alias("x")).collect():
        mass[r["klass"]] = r["x"]
    model.settle(class_bigrams(rows.where("not held_out"), m), mass)
    return model, table, rows


def train(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> tuple[ClassModel, DataFrame]:
    """The model, and the written table of all training words (word, c, klass)."""
    return fit(df, scratch, text_col, id_col)[:2]


def score(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, and perplexity by the class model, for each row."""
    model, _, rows = fit(df, scratch, text_col, id_col)
    shared = df.sparkSession.sparkContext.broadcast(model.factor)
    schema = rows.withColumn("factors", F.lit(0.0)).drop("path").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            a = [np.frombuffer(p, np.int16) for p in b.column("path").to_pylist()]
            sums = pa.array([float(shared.value[x[:-1], x[1:]].sum()) for x in a], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) if f.name != "factors" else sums for f in arrow], schema=arrow)

    whole = rows.mapInArrow(run, schema)
    total = F.col("logs") + F.col("factors")
    return whole.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(model.log_mass)).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
