"""Edge rows by hand, and invariants."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from glyphflow.functions import geometry as G
from glyphflow.functions import layout as L
from glyphflow.functions import text as T
from glyphflow.operators import cache as C
from glyphflow.operators import detection as D
from glyphflow.operators import models as M
from glyphflow.operators import pages as P
from glyphflow.streaming import canvas, runs

BOX = "page_id long, box_idx int, min_x int, min_y int, max_x int, max_y int, confidence double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], BOX)


def test_equal_boxes_remove_each_other(spark):
    assert D.innermost(boxes(spark, (0, 0, 9, 9, 0.5), (0, 0, 9, 9, 0.5))).count() == 0
    kept = D.innermost(boxes(spark, (0, 0, 9, 9, 0.5), (1, 1, 8, 8, 0.4)))
    assert [r.box_idx for r in kept.collect()] == [1]


def test_suppression_at_the_threshold(spark):
    # intersection 50 over union 100 is exactly one half
    b = boxes(spark, (0, 0, 10, 10, 0.9), (0, 0, 10, 5, 0.8), (20, 20, 30, 30, 0.8))
    assert sorted(r.box_idx for r in D.suppress(b).collect()) == [0, 2]
    assert D.suppress(b, 0.51).count() == 3
    tie = boxes(spark, (0, 0, 10, 10, 0.7), (0, 0, 10, 10, 0.7))
    assert [r.box_idx for r in D.suppress(tie).collect()] == [0]


def test_kept_boxes_do_not_overlap(spark):
    random.seed(2)
    b = boxes(spark, *[(x, y, x + 40, y + 40, random.random()) for x, y in ((random.randrange(100), random.randrange(100)) for _ in range(60))])
    kept = D.suppress(b)
    a, c = kept.alias("a"), kept.alias("c")
    worst = a.join(c, F.expr("a.page_id = c.page_id and a.box_idx < c.box_idx")).agg(F.max(G.iou(F.struct("a.*"), F.struct("c.*")))).first()[0]
    assert worst < 0.5


def test_touching_boxes_are_one_group(spark):
    b = boxes(spark, (0, 0, 10, 10, 0.5), (10, 0, 20, 10, 0.5), (500, 500, 510, 510, 0.5), (0, 0, 5, 0, 0.5))
    assert {r.box_idx: r.group_id for r in D.group_numbers(b).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}


def test_blocks_do_not_depend_on_order(spark):
    random.seed(4)
    lines = [(x, y, x + random.randrange(5, 60), y + random.randrange(5, 40), 0.5) for x, y in ((random.randrange(400), random.randrange(400)) for _ in range(25))]
    found = None
    for _ in range(3):
        random.shuffle(lines)
        now = sorted((r.min_x, r.min_y, r.max_x, r.max_y) for r in D.derive_blocks(boxes(spark, *lines)).collect())
        assert found in (None, now)
        found = now
    merged = [list(b[:4]) for b in lines]
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(merged, 2):
            if a[0] - 30 <= b[2] and a[2] + 30 >= b[0] and a[1] - 30 <= b[3] and a[3] + 30 >= b[1]:
                merged.remove(a), merged.remove(b)
                merged.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])])
                changed = True
                break
    assert found == sorted(tuple(m) for m in merged if (m[2] - m[0]) * (m[3] - m[1]) >= 500)


def test_z_index_is_a_permutation(spark):
    b = boxes(spark, (0, 0, 5, 5, 0.1), (0, 0, 9, 9, 0.1), (1, 1, 6, 6, 0.1))
    assert [r.z_index for r in L.z_order(b).orderBy("box_idx").collect()] == [2, 1, 3]


def test_floor_division_is_exact(spark):
    pairs = [(h, n) for h in range(0, 3000, 7) for n in range(1, 40)] + [(42, 7)]
    df = spark.createDataFrame(pairs, "h int, n int").select("h", "n", G.floor_div(F.col("h").cast("double"), F.col("n") * F.lit(1.2)).alias("q"))
    assert all(r.q == r.h // (r.n * 1.2) for r in df.collect())


def test_japanese_text(spark):
    cases = {"ゴゴゴゴゴゴゴ": True, "ドンドンドンドン": True, "アイウエオカ": True, "アイウエオカキ": False, "": False, "　": False, "hello": False, "日本go": True, "ー": True, "。。。": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.is_japanese(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == cases
    p = spark.createDataFrame([("ー・ー",)], "t string").select(T.profile(F.col("t")).alias("p")).first().p
    assert (p.katakana, p.punctuation) == (3, 0)


def test_clean_up(spark):
    df = spark.createDataFrame([("Assistant: Hi</s>", "ゴ ー　ル!! ok")], "a string, b string")
    r = df.select(T.clean_output(F.col("a")).alias("a"), T.join_spaced(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == ("Hi", "ゴール!! ok")
    reply = spark.createDataFrame([("1. one\n2. two\nthree\n4. four",)], "r string").select(T.numbered_reply(F.col("r"), F.lit(3)).alias("x")).first().x
    assert reply == ["one", "two", "three"]


def test_pages_without_boxes_stay(spark):
    images = spark.createDataFrame([(1, 0), (1, 1)], "request_id long, image_idx long")
    some = spark.createDataFrame([(1, 1, 0, 7)], "request_id long, image_idx long, box_pos int, min_x int")
    assert P.respond(images, some, ["min_x"]).first().response == '[[],[{"min_x":7}]]'


def test_missing_model_in_key(spark):
    r = spark.createDataFrame([("en", None, "d")], "l string, m string, d string").select(C.cache_key(F.col("l"), F.col("m"), F.col("d")).alias("k")).first()
    assert r.k.startswith("en:unknown:")


def test_unknown_model():
    try:
        M.detect(F.lit("x"), "none")
    except ValueError as e:
        assert "unknown" in str(e)
    else:
        raise AssertionError


def test_stream_keeps_state_between_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frames = spark.createDataFrame([(1, 1, 10, 5), (2, 1, 20, 5), (3, 1, 30, 6), (4, 2, 40, 1)], "event_id long, canvas_id long, ts long, px_sum long")
    frames.where("ts <= 20").coalesce(1).write.parquet(src)
    for part in (None, "ts > 20"):
        if part:
            frames.where(part).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(frames.schema).parquet(src)
        q = canvas.change_stream(s).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    found = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert found == sorted(r.event_id for r in canvas.changes(frames).collect()) == [3]


def test_cache_upsert(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "key string, value int, seq int")
    table = runs.upsert_cache(first, str(tmp_path / "none"), "key", "seq")
    assert {r.key: r.value for r in table.collect()} == {"a": 2, "b": 3}


def test_rejected_requests_take_no_place(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, rng.randrange(60)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) as ts")
    want = {}
    for user in range(3):
        ends = []
        for i, _, s in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            ends = [e for e in ends if e > s]
            want[i] = (len(ends), len(ends) < 3)
            if len(ends) < 3:
                ends.append(s + 10)
    got = {r.event_id: (r.running, r.admitted) for r in C.admitted(df, "user_id", "ts", 10, order="event_id").collect()}
    assert got == want


def test_requests_for_what_is_running_are_rejected(spark):
    rows = [(1, "u", 0, "a"), (2, "u", 1, "a"), (3, "u", 2, "b"), (4, "u", 3, "c"), (5, "u", 4, "d"), (6, "u", 10, "a"), (7, "v", 1, "a"), (8, "u", 10, None), (9, "u", None, "z")]
    df = spark.createDataFrame(rows, "event_id int, user string, s int, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: (r.running, r.admitted) for r in C.admitted(df, "user", "ts", 10, order="event_id", identity="kind").collect()}
    # 2 asks for what 1 has, 5 finds three; 6 comes as 1 has ended and takes its place
    assert got == {1: (0, True), 2: (1, False), 3: (1, True), 4: (2, True), 5: (3, False), 6: (2, True), 7: (0, True), 8: (3, False), 9: (0, True)}


def test_candidates_must_be_visible_whatever_they_are(spark):
    from glyphflow.operators import discovery

    cols = "element_id int, host_page_id int, kind string, complete boolean, width int, height int, left_px int, top_px int"
    rows = [(k * 3 + i, 1, kind, True, 200, 200, left, 0) for k, kind in enumerate(("img", "canvas", "background")) for i, left in enumerate((0, 1280, -200))]
    assert sorted(r.element_id for r in discovery.candidates(spark.createDataFrame(rows, cols)).collect()) == [0, 3, 6]


def test_reply_lines_split_at_the_first_mark(spark):
    reply = "\n1. Hello. World\n\n3. a\nplain\n5. b"
    got = spark.createDataFrame([(reply,)], "r string").select(T.numbered_reply(F.col("r"), F.lit(4)).alias("x")).first().x
    assert got == [t.split(". ", 1)[-1] for t in reply.strip().split("\n")][:4] == ["Hello. World", "", "a", "plain"]


def test_wrapping_long_texts(spark):
    rng = random.Random(3)
    texts = ["", " ", "word", "x" * 100, " ".join("ab" * rng.randrange(12) for _ in range(3000)), "a  b"]

    def slow(t):
        lines, now = [], ""
        for w in t.split(" "):
            longer = f"{now} {w}" if now else w
            if len(longer) > 24 and now:
                lines.append(now)
                now = w
            else:
                now = longer
        lines += [now] if now else []
        return lines or [t]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.l for r in df.select("i", L.wrap(F.col("t"), F.lit(24)).alias("l")).collect()} == dict(enumerate(map(slow, texts)))


def test_wrapping_takes_time_by_length(spark):
    import time

    words = ["ab" * (1 + i % 9) for i in range(400_000)]
    lines, now = [], ""
    for w in words:
        longer = f"{now} {w}" if now else w
        if len(longer) > 24:
            lines.append(now)
            longer = w
        now = longer
    lines.append(now)
    df = spark.createDataFrame([(" ".join(words),)], "t string").select(L.wrap(F.col("t"), F.lit(24)).alias("l")).select(F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("h"))
    began = time.time()
    got = df.first()
    assert time.time() - began < 30
    assert (got.n, got.h) == (len(lines), hashlib.md5("|".join(lines).encode()).hexdigest())


def test_wrapping_keeps_spaces_and_counts_code_points(spark):
    texts = {"x" * 24 + "  y": ["x" * 24, "y"], "x" * 23 + "  y": ["x" * 23 + " ", "y"], "a  ": ["a  "], "   a": ["a"], "   ": ["   "], "😀" * 24 + " b": ["😀" * 24, "b"], "a\n b\n": ["a\n b\n"], None: [None]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.l for r in df.select("t", L.wrap(F.col("t"), F.lit(24)).alias("l")).collect()} == texts
    assert df.select(L.wrap(F.lit("a bc  d"), F.lit(0)).alias("l")).first().l == ["a", "bc", "d"]


def test_session_helpers(spark):
    from glyphflow.operators import session as S

    df = spark.createDataFrame([(1, b"x", "/ws/translate/French"), (2, b"", "/ws/translate"), (3, None, "/ws/translate/")], "seq int, frame binary, path string")
    got = {r.seq: (r.target_language, r.success, r.error, r.answer) for r in S.replies(df, "frame", "path", F.length("frame")).collect()}
    assert got == {1: ("French", True, None, 1), 2: ("English", False, S.NO_IMAGE, None), 3: ("English", False, S.NO_IMAGE, None)}
    o = spark.createDataFrame([(1, 0, "blk", 3), (1, 1, "seg", 4), (1, 2, "det", 4), (2, 0, "a", 3), (2, 1, "b", 4), (2, 2, "c", 4), (3, 0, "a", 2), (4, 0, "mask", 3), (4, 1, "x", 3)], "m int, pos int, name string, ndim int")
    assert {r.m: (r.blocks, r["mask"], r.lines) for r in S.output_roles(o, "m").collect()} == {1: (0, 1, 2), 2: (0, 1, 2), 3: (None, None, None), 4: (0, 0, 1)}


def test_percentiles_of_many_values(spark):
    import numpy as np

    from glyphflow.operators import stats

    rng = random.Random(9)
    groups = {"a": [rng.gauss(0, 1) for _ in range(5000)], "b": [float(rng.randrange(3)) for _ in range(3000)], "c": [1.5], "d": [2.0, 1.0], None: [float(x) for x in range(700)], "e": [rng.random() ** 9 for _ in range(901)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for accuracy in (50, 1000, 10_000):  # most groups are larger than the first, none than the last
        got = {r.k: r.p for r in stats.percentiles(df, "k", "v", accuracy=accuracy).collect()}
        assert got.pop("f") is None and got.keys() == groups.keys()
        for k, vs in groups.items():
            assert np.allclose(got[k], np.percentile(vs, [50, 95, 99]), rtol=0, atol=1e-12)
    assert stats.percentiles(df.limit(0), "k", "v").count() == 0


def test_elements_of_markup(spark):
    from glyphflow.operators import discovery

    html = """<img src='a b.png' WIDTH = "640" height=480px><IMG SRC=c.png width="50%"><image src=x><div
 style='background: red url("d.jpg") no-repeat' width=10><div class=y><SECTION style="background-image:url(e.jpg)"><canvas height=9999999999>
 <!-- <img src=f> --> <style>.x{background:url(g)}</style><script>'<canvas>'</script><main style="color:red"><article data-style="url(h)"><img data-src=i>"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>no</p>")], "page_id int, html string")
    got = [tuple(r) for r in discovery.elements(rows, "page_id", "html").orderBy("pos").collect()]
    # div 3, main 6 and article 7 have no picture
    assert got == [(1, 0, "img", "a b.png", 640, 480), (1, 1, "img", "c.png", None, None), (1, 2, "background", "d.jpg", 10, None), (1, 4, "background", "e.jpg", None, None), (1, 5, "canvas", None, None, None), (1, 8, "img", None, None, None)]
