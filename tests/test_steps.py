"""Streams, sessions, models and requests on edge rows by hand."""

import random
import threading

from pyspark.sql import functions as F

from glyphflow.operators import models as M
from glyphflow.operators import session as S
from glyphflow.sources import files, requests
from glyphflow.streaming import canvas, runs

FRAMES = "event_id long, canvas_id long, ts long, px_sum long"


def frame_rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice((1, 1, 1, 2, None)), rng.choice((None, *range(0, 30000, 700))) if seed % 2 else i * 61, rng.choice((1, 2, None))) for i in range(n)]


def changed(rows):
    last, out = {}, []
    for i, c, t, px in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        if c in last and None not in (last[c], px) and px != last[c]:
            out.append(i)
        last[c] = px
    return sorted(out)


def test_changes_across_slices(spark):
    for seed in (1, 2):
        rows = frame_rows(seed)
        df = spark.createDataFrame(rows, FRAMES).withColumn("ts", F.timestamp_seconds("ts"))
        for slice_s in (1, 3600, 10**6):
            assert sorted(r.event_id for r in canvas.changes(df, slice_s).collect()) == changed(rows)


def test_steps_repeat_without_doubles(spark, tmp_path):
    where, rows = str(tmp_path), frame_rows(2)
    step = canvas.change_steps(spark, where)
    cuts = [rows[:100], rows[100:101], [], rows[101:]]
    for n, part in enumerate(cuts):
        df = spark.createDataFrame(part, FRAMES).withColumn("ts", F.timestamp_seconds("ts"))
        step(df, n)
        step(df, n)  # after a failure
    assert sorted(r.event_id for r in spark.read.parquet(f"{where}/rows").collect()) == changed(rows)


def test_two_models_overlap_and_keep_errors(spark):
    seen = []

    class Slow:
        def __call__(self, texts):
            seen.append(threading.get_ident())
            if "bad" in texts:
                raise ValueError("unreadable")
            return [t.upper() for t in texts]

    M.register("ocr", "slow", Slow)
    M.register("translate", "odd", lambda: lambda pairs: [f"{lang}:{t}" for t, lang in pairs if not (t == "C" and int("x"))])
    rows = [(1, "a", "de"), (2, "bad", "de"), (3, " ", "fr"), (4, None, "fr"), (5, "c", "fr"), (6, "d", None)]
    df = spark.createDataFrame(rows, "i int, t string, l string").coalesce(1)
    got = {r.i: tuple(r.r) for r in df.select("i", M.read_and_translate(F.col("t"), F.col("l"), "slow", "odd", size=2).alias("r")).collect()}
    assert got == {1: ("A", "de:A", None), 2: ("", "", "unreadable"), 3: (" ", "", None), 4: ("", "", None), 5: ("C", "", None), 6: ("D", ":D", None)}
    plan = df.select(M.read_and_translate(F.col("t"), F.col("l"), "slow", "odd"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_providers_in_order():
    tried = []

    def load(name, ok):
        def f():
            tried.append(name)
            if not ok:
                raise RuntimeError(name)
            return name

        return f

    assert M.first_provider(load("a", False), load("b", True), load("c", True))() == "b" and tried == ["a", "b"]
    try:
        M.first_provider(load("a", False), load("b", False))()
    except RuntimeError as e:
        assert str(e) == "b"
    else:
        raise AssertionError
    assert M.one_by_one(lambda: lambda v: [len(v)])()([1, 2, 3]) == [1, 1, 1]


def test_fetches(spark):
    rows = [(1, "data:text/plain,hi"), (2, None), (3, "none:x"), (4, "file:///etc/hostname"), (5, "data:text/plain,hi"), (6, "data:;base64,")]
    got = {r.i: (r.success, r.content, r.error is not None) for r in requests.fetched(spark.createDataFrame(rows, "i int, u string"), "u").collect()}
    hi = (True, "data:text/plain;base64,aGk=", False)
    assert got == {1: hi, 2: (False, None, True), 3: (False, None, True), 4: (False, None, True), 5: hi, 6: (True, "data:text/plain;base64,", False)}


def test_resets(spark):
    t = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "z", 3)], "k string, v string, n int")
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("q",)], "k string")
    assert sorted(requests.reset(t, keys, "k", {"v": "d"}).collect(), key=lambda r: r.v) == [("a", "d", None), ("b", "y", 2), (None, "z", 3)]


def test_connections_and_views(spark):
    calls = [("s", 1, "de", 5), ("s", 2, "de", 30_001), ("s", 3, "fr", 30_000), ("s", 4, None, None), ("s", 5, None, 1), ("s", 6, "de", 1), ("t", 1, None, 1)]
    df = spark.createDataFrame(calls, "s string, i int, l string, ms int")
    got = {(r.s, r.i): (r.connection, r.opened, r.error) for r in S.connections(df, "s", "i", "l", "ms").collect()}
    assert got == {("s", 1): (1, True, None), ("s", 2): (1, False, S.TIMED_OUT), ("s", 3): (2, True, None), ("s", 4): (3, True, None), ("s", 5): (3, False, None), ("s", 6): (4, True, None), ("t", 1): (1, True, None)}
    places = [(1, 0, 0), (2, 10, 0), (3, 0, 901), (4, 0, 900), (5, None, 0), (6, -200, 0), (7, -201, 0), (8, 200, 0)]
    df = spark.createDataFrame(places, "i int, left_px int, top_px int").selectExpr("*", "1 as e", "100 as width", "1 as height")
    assert sorted(r.i for r in S.entered_view(df, "e", "i", 800, 800).collect()) == [1, 4, 6, 8]


def test_config(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("nc: 2\nnames: [a, 'b c']\nsub:\n  lr: 0.1\n")
    assert files.config(spark, str(tmp_path / "d.yaml")) == {"nc": 2, "names": ["a", "b c"], "sub": {"lr": 0.1}}
    (tmp_path / "e.yaml").write_text("")
    assert files.config(spark, str(tmp_path / "e.yaml")) == {}


def test_drained_by_the_clock(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = runs.drained(spark, s, s.schema, interval="1 second")
    assert sorted(r.id for r in got.collect()) == list(range(50))
