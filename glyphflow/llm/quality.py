"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows.

A tree cuts the box of all labelled rows' statistics by random splits (a random statistic, a random value within the
box) until a part holds at most one of its sample of good rows. A document that lands in a thinly populated part has a
short path. The path length below which a document is rejected is set over all labelled rows that the base rules pass: of
the thresholds that reject at most LOSS of the good rows, that which catches most bad ones and, among equals, loses fewest
good ones; it lies halfway up the gap above. Without labelled rows of both kinds the method rejects none.
A null text has no words; null labels count as unlabelled; an id that is labelled twice counts twice; repeated rows and
equal statistics are judged alike, and a path just as long as the threshold is kept. A very long text is one row of sums.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, neutral

#: Good labelled rows that the forest is fitted on at most (those with the smallest hashes of their ids), trees, rows and depth of a tree.
FIT_ROWS, TREES, TREE_ROWS, DEPTH = 4096, 128, 256, 12
#: Share of good labelled rows that the calibrated threshold may reject.
LOSS = 0.005
BINS = 4000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
SCHEMA = ", ".join(f"{c} long" for c in STATS)
SPACE, SYMBOLS, MARKS, UPPER, DIGITS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"!?;=_~^@\\/+{}[]", bytes(range(65, 91)), bytes(range(48, 58))
FOLLOW = bytes(range(128, 192))


def statistics(text: bytes) -> tuple[int, ...]:
    """The rule statistics of a text, in the order of STATS."""
    words = text.split()
    n = len(words)
    size = len(text)
    without = lambda drop: size - len(text.translate(None, drop))
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, size - without(FOLLOW) - without(SPACE), without(SYMBOLS), dup, repeated, lines, without(UPPER), without(DIGITS), without(MARKS), len(set(words))


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios, so that a document's length alone makes no anomaly. stats: a column for each of STATS."""
    n, chars, symbols, dup, repeat, lines, upper, _, marks, distinct = (stats[:, k].astype(float) for k in range(len(STATS)))
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    return np.column_stack([symbols / w, marks / w, upper / c, dup / (lines + 5), repeat / w, np.minimum(chars / w, 40), np.where(n >= 20, distinct / w ** 0.9, 1.0)])


class Forest:
    """Trees as arrays: the statistic and value of each split, the children, and the path length of each end."""

    def __init__(self, good: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = []
        spread = np.where(high > low)[0]
        for _ in range(TREES):
            rows = good[rng.choice(len(good), min(TREE_ROWS, len(good)), replace=False)]
            nodes: list = []

            def grow(rows, lo, hi, depth, nodes=nodes):
                at = len(nodes)
                nodes.append(None)
                if depth >= DEPTH or len(rows) <= 1 or not len(spread):
                    n = len(rows)
                    nodes[at] = (-1, 0.0, 0, 0, depth + (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n > 1)))
                    return at
                k = rng.choice(spread)
                cut = rng.uniform(lo[k], hi[k])
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[k] = right_lo[k] = cut
                side = rows[:, k] < cut
                a = grow(rows[side], lo, left_hi, depth + 1)
                b = grow(rows[~side], right_lo, hi, depth + 1)
                nodes[at] = (k, cut, a, b, 0.0)
                return at

            grow(rows, low.copy(), high.copy(), 0)
            k, cut, a, b, path = map(np.array, zip(*nodes))
            self.trees.append((k, cut, a, b, path))

    def path_length(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for k, cut, a, b, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                stat = k[at]
                inner = stat >= 0
                if not inner.any():
                    break
                nxt = np.where(x[rows, np.maximum(stat, 0)] < cut[at], a[at], b[at])
                at = np.where(inner, nxt, at)
            total += path[at]
        return total / len(self.trees)


class QualityModel:
    """The forest (None: rejects none) and the path length below which a document is rejected."""

    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def paths(self, stats: np.ndarray) -> np.ndarray:
        return self.forest.path_length(features(stats)) if self.forest is not None and len(stats) else np.full(len(stats), math.inf)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def rule_statistics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the rule statistics to the kept columns; map-only."""
    return map_texts(df, text_col, list(df.columns) if keep is None else keep, SCHEMA, lambda found, _: [statistics(t) for t in found])


def calibrate(bad: np.ndarray, good: np.ndarray, loss: float = LOSS) -> int:
    """The number of bins, from the shortest paths up, that are rejected; bad and good: labelled rows in each bin."""
    lost = np.concatenate([[0], np.cumsum(good)])
    caught = np.concatenate([[0], np.cumsum(bad)])
    within = np.where(lost <= loss * lost[-1])[0]
    least = int(within[np.argmax(caught[within])])  # the first of those that catch most
    if not caught[least]:
        return 0
    same = within[(caught[within] == caught[least]) & (lost[within] == lost[least])]
    return int(least + (same[-1] - least) // 2)


def fit(stats: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> QualityModel:
    """Fits the forest on at most FIT_ROWS good rows; ranges and threshold come from all labelled rows.

    stats: rule_statistics() with id_col. labels: id_col and quality (1 good, 0 bad).
    """
    cols = [F.col(c) for c in STATS]
    labelled = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_quality")).where("_quality in (0, 1)")
    rows = scratch.write(stats.select(F.col(id_col).alias("_id"), *cols).join(labelled, "_id").where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words"))
    try:
        return fitted(rows, cols)
    finally:
        scratch.drop(rows)


def fitted(rows: DataFrame, cols: list) -> QualityModel:
    """The model from labelled rows (_id, _quality and the statistics)."""
    sample = rows.where("_quality = 1").orderBy(F.xxhash64("_id"), *cols).limit(FIT_ROWS).select(*cols).collect()
    if len(sample) < 2:
        return QualityModel(None, -math.inf)

    def edges(batches):
        for batch in batches:
            if batch.num_rows:
                x = features(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS]))
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(x.shape[1]), pa.int32()), "lo": pa.array(x.min(0)), "hi": pa.array(x.max(0))})

    box = sorted((r["k"], r["lo"], r["hi"]) for r in rows.select(*cols).mapInArrow(edges, "k int, lo double, hi double").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    forest = Forest(features(np.array(sample, dtype=float)), np.array([b[1] for b in box]), np.array([b[2] for b in box]))
    whole = QualityModel(forest, -math.inf)
    top = float(DEPTH + 12)

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS])
                b = np.clip(whole.paths(x) / top * BINS, 0, BINS - 1).astype(np.int64)
                codes, n = np.unique(b * 2 + batch.column("_quality").to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

    hist = np.zeros((BINS, 2))
    for r in rows.select("_quality", *cols).mapInArrow(binned, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        hist[r["code"] // 2, r["code"] % 2] += r["n"]
    if not hist[:, 0].sum():
        return QualityModel(None, -math.inf)
    return QualityModel(forest, calibrate(hist[:, 0], hist[:, 1]) * top / BINS)


def judged(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Adds base_failed, path_length and kept to rows with the rule statistics."""
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([*stats.schema.fields, StructField("base_failed", BooleanType()), StructField("path_length", DoubleType()), StructField("kept", BooleanType())])
    arrow = to_arrow_schema(out)
    shared = stats.sparkSession.sparkContext.broadcast(model)  # TREES trees of fixed depth and sample

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS]) if batch.num_rows else np.zeros((0, len(STATS)))
            path, failed = shared.value.paths(x), base_failed(x)
            own = [batch.column(k).cast(arrow.field(k).type) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(failed), pa.array(np.minimum(path, 1e9)), pa.array(~failed & (path >= shared.value.threshold))], schema=arrow)

    return stats.mapInArrow(run, out)


def judge(df: DataFrame, labels: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, the rule statistics, base_failed, path_length and kept for each row; texts are read once."""
    stats = scratch.write(rule_statistics(df, text_col, [id_col]))
    return judged(stats, fit(stats, labels, scratch, id_col))


def keep_good(df: DataFrame, labels: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df, all columns, that the base rules and the method keep. Texts are read twice and never shuffled."""
    stats = scratch.write(rule_statistics(df, text_col, [id_col]))
    model = df.sparkSession.sparkContext.broadcast(fit(stats, labels, scratch, id_col))
    scratch.drop(stats)

    def each(found, _):
        x = np.array([statistics(t) for t in found], dtype=np.int64).reshape(-1, len(STATS))
        return [(bool(k),) for k in ~base_failed(x) & (model.value.paths(x) >= model.value.threshold)]

    plain, name = neutral(df)
    return map_texts(plain, name[text_col], plain.columns, "kept boolean", each).where("kept").drop("kept").toDF(*df.columns)
