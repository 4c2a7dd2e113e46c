"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents' words, as word numbers of the test phrases' vocabulary (any other word is a break, and so
is a document's end). Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix with ranks at every
place. Test windows are searched backwards through those ranks, all at once; matches are located by stepping back to
sampled suffix positions. Located windows become word spans, merged per document. Long documents go into pieces that
overlap by a window less a word, so a shard's size is bounded and no match is lost.

A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. Null texts have no
words. Items are handled in blocks of at most BLOCK_WORDS words; where there is more than one block, the blocks' spans of a
document meet by a row number. Repeated item ids count once, with all their windows; the windows of an item without an id
hit words, but no item is counted for them. Repeated rows are judged each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, map_texts, neutral

WINDOW = 13
#: Words of a shard, of a piece of a document, and of a block of items at most; every SAMPLE-th position is kept.
SHARD_WORDS, PIECE_WORDS, BLOCK_WORDS, SAMPLE = 1 << 19, 1 << 17, 1 << 20, 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By doubling; s holds ranks from 0 up, its ends are unique. Only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    key = s[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = starts
    step = 1
    tied = np.where(~(first & np.concatenate([first[1:], [True]])))[0]  # places in the order
    while len(tied):
        at = order[tied]
        nxt = at + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1) + 1
        group = rank[at]
        mix = (group << 32) | second
        sub = np.argsort(mix, kind="stable")
        at, mix = at[sub], mix[sub]
        order[tied] = at
        m = len(tied)
        first = np.concatenate([[True], mix[1:] != mix[:-1]])
        starts = tied[np.maximum.accumulate(np.where(first, np.arange(m), 0))]
        rank[at] = starts
        single = first & np.concatenate([first[1:], [True]])
        tied = tied[~single]
        step *= 2
    return order


class FMIndex:
    """Of a sequence of symbols; the wavelet matrix has one level a bit of the symbols."""

    def __init__(self, s: np.ndarray, sa: np.ndarray, size: int):
        self.n = len(s)
        bwt = s[sa - 1]  # of the first suffix: the last symbol
        before_break = bwt == 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
        self.bits = max(1, int(size - 1).bit_length())
        self.ranks, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level) & 1
            ones = np.empty(self.n + 1, dtype=np.int32)
            ones[0] = 0
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            up = bit.astype(bool)
            bwt = np.concatenate([bwt[~up], bwt[up]])
        kept = (sa % SAMPLE == 0) | before_break  # breaks have no order in the transform, so no step crosses one
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = sa[kept]

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol c stands in the transform before `at`."""
        begin = np.zeros_like(at)
        for k in range(self.bits):
            ones, zeros = self.ranks[k], self.zeros[k]
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[at], ones[begin]
            at = np.where(one, zeros + a, at - a)
            begin = np.where(one, zeros + b, begin - b)
        return at - begin

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one place to the left."""
        at, c = rows, np.zeros_like(rows)
        begin = np.zeros_like(rows)
        for k in range(self.bits):
            ones, zeros = self.ranks[k], self.zeros[k]
            one = ones[at + 1] > ones[at]
            a, b = ones[at], ones[begin]
            c = c << 1 | one
            at = np.where(one, zeros + a, at - a)
            begin = np.where(one, zeros + b, begin - b)
        return self.first[c] + at - begin

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern (a line of symbols, the last ones first to be read)."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= k) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = patterns[live, lengths[live] - k]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the rows' suffixes."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            found = self.kept[rows]
            out[todo[found]] = self.sampled[self.kept_before[rows[found]]] + steps
            todo, rows = todo[~found], rows[~found]
            if len(rows):
                rows = self.back(rows)
            steps += 1
        return out


class Phrases:
    """A block of test items: vocabulary, distinct windows, and the items of each window."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            # from 1 up: 0 is the break
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + WINDOW]), set()).update(() if item is None else (str(item),))
        self.items = [sorted(x) for x in windows.values()]
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.lines = np.zeros((len(windows), WINDOW), dtype=np.int64)
        for k, w in enumerate(windows):
            self.lines[k, : len(w)] = w
        self.shortest = int(self.lengths.min()) if len(windows) else WINDOW

    def search(self, shard: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """For each sequence of word numbers, (position, window) of all matches."""
        found: list[list[tuple[int, int]]] = [[] for _ in shard]
        # only runs of the vocabulary's words that can hold a window are indexed; between them stands a break of its own
        parts, where = [], []
        for k, ids in enumerate(shard):
            known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
            edge = np.diff(known)
            begin, end = np.where(edge == 1)[0], np.where(edge == -1)[0]
            for a, b in zip(begin.tolist(), end.tolist()):
                if b - a >= self.shortest:
                    parts.append(ids[a:b])
                    where.append((k, a))
        if not parts or not self.items:
            return found
        sizes = np.array([len(p) + 1 for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.zeros(int(starts[-1]), dtype=np.int64)
        for p, at in zip(parts, starts):
            symbols[at : at + len(p)] = p
        breaks = symbols == 0
        unique = symbols + len(parts)  # ranks for sorting: breaks differ, and stand before all words
        unique[breaks] = np.arange(len(parts))
        index = FMIndex(symbols, suffix_array(unique), len(self.vocabulary) + 1)
        lo, hi = index.search(self.lines, self.lengths)
        n = np.maximum(hi - lo, 0)
        if n.sum():
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            places = index.locate(rows)
            part = np.searchsorted(starts, places, side="right") - 1
            for w, p, at in zip(which.tolist(), part.tolist(), places.tolist()):
                k, a = where[p]
                found[k].append((at - int(starts[p]) + a, w))
        return found


def match(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(number of words, merged spans [first word, word after the last), items found) of each text, shard by shard."""
    results, shard, owners, size = [], [], [], 0
    get = phrases.vocabulary.get

    def flush():
        nonlocal shard, owners, size
        for (row, base), found in zip(owners, phrases.search(shard)):
            results[row][1].extend((base + at, w) for at, w in found)
        shard, owners, size = [], [], 0

    for t in texts:
        words = alnum_words(t)
        results.append((len(words), []))
        for base in range(0, max(len(words), 1), PIECE_WORDS):
            piece = words[base : base + PIECE_WORDS + WINDOW - 1]
            if len(piece) < phrases.shortest:
                continue
            shard.append(np.fromiter((get(w, 0) for w in piece), dtype=np.int64, count=len(piece)))
            owners.append((len(results) - 1, base))
            size += len(piece)
            if size >= SHARD_WORDS:
                flush()
    flush()
    out = []
    for n, found in results:
        spans, items = [], set()
        for at, w in sorted(found):
            end = at + int(phrases.lengths[w])
            items.update(phrases.items[w])
            if spans and at <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((at, end))
        out.append((n, spans, sorted(items)))
    return out


def item_blocks(benchmark: DataFrame, text_col: str, item_col: str):
    """Blocks of items, read one after another, each of at most BLOCK_WORDS words (or one item)."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for item, text in rows.toLocalIterator():
        block.append((item, text.encode()))
        size += len(text) // 2 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


SPANS = "n_words long, spans array<struct<first: long, after: long>>, items array<string>"


def _one_block(df: DataFrame, items, text_col: str, keep: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words
    made = []

    def each(found, _):
        if not made:
            made.append(Phrases(shared.value))
        return [(n, [{"first": a, "after": b} for a, b in spans], own) for n, spans, own in match(found, made[0])]

    return map_texts(df, text_col, keep, SPANS, each)


def find_spans(df: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds n_words, spans (merged runs of hit words) and items (ids of items with occurring windows, sorted) to the kept columns."""
    keep = list(df.columns) if keep is None else keep
    blocks = list(_first_two(item_blocks(benchmark, item_text_col, item_col)))
    if len(blocks) < 2:
        return _one_block(df, blocks[0] if blocks else [], text_col, keep)
    # more blocks: the rows get numbers in a written table, and each block's spans meet again by them
    plain, name = neutral(df)
    numbered = scratch.write(plain.withColumn("_row", F.monotonically_increasing_id()))
    parts = [_one_block(numbered, b, name[text_col], ["_row"]) for b in item_blocks(benchmark, item_text_col, item_col)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    met = whole.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    keep = [c for c in keep if c.lower() not in ("n_words", "spans", "items")]
    return numbered.select("_row", *[name[c] for c in keep]).join(met.mapInArrow(_merged, met.schema), "_row").drop("_row").toDF(*keep, "n_words", "spans", "items")


def _merged(batches):
    """Rows whose sorted spans may touch or overlap, with merged ones."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            spans: list[dict] = []
            for x in r["spans"]:
                if spans and x["first"] <= spans[-1]["after"]:
                    spans[-1]["after"] = max(spans[-1]["after"], x["after"])
                else:
                    spans.append(dict(x))
            r["spans"] = spans
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _first_two(blocks):
    for k, b in enumerate(blocks):
        yield b
        if k:
            return


def contaminated(n_words, n_hit):
    """The rule: some hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


N_HIT = "aggregate(spans, 0L, (n, x) -> n + x.after - x.first)"


def report(found: DataFrame, keep: list[str]) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from find_spans()."""
    n_hit = F.expr(N_HIT)
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated(F.col("n_words"), n_hit).alias("contaminated"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that are not contaminated."""
    plain, name = neutral(df)
    found = find_spans(plain, benchmark, scratch, name[text_col])
    return found.where(~contaminated(F.col("n_words"), F.expr(N_HIT))).drop("n_words", "spans", "items").toDF(*df.columns)
