"""File sources and sinks on small fixtures."""

import base64
import json

from pyspark.sql import functions as F

from glyphflow.operators import stats
from glyphflow.sources import files, requests


def test_requests(spark):
    uri = "data:image/png;base64," + base64.b64encode(b"px,1").decode()
    bodies = [(1, json.dumps({"base64Images": [uri, base64.b64encode(b"two").decode()]})), (2, json.dumps({"base64Images": []})), (3, json.dumps({"base64Images": [uri] * 6, "targetLanguage": "German"})), (4, "{broken"), (5, None)]
    r = requests.parsed(spark.createDataFrame(bodies, "id int, body string"))
    assert {x.id: x.valid for x in r.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    rows = requests.image_rows(r).orderBy("image_idx").collect()
    assert [(x.image_idx, bytes(x.content), x.target_language) for x in rows] == [(0, b"px,1", "English"), (1, b"two", "English")]


def test_image_listing(spark, tmp_path):
    for name in ("a.jpg", "b.png", "c.webp", "d.txt", "e.jpeg"):
        (tmp_path / name).write_bytes(b"x" * 3)
    found = files.images(spark, str(tmp_path))
    assert found.select(F.substring_index("path", "/", -1).alias("n")).orderBy("n").toPandas().n.tolist() == ["a.jpg", "b.png", "c.webp", "e.jpeg"]
    assert files.folder_sizes(found, str(tmp_path)).agg(F.sum("bytes")).first()[0] == 12
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "a.jpg")]).endswith("a.jpg")


def test_labels_and_summary(spark, tmp_path):
    for split, lines in (("train", "0 .1 .2\n1 .5 .5\n\n0 .3 .3\n"), ("valid", "0 .1 .1\n")):
        folder = tmp_path / split / "labels"
        folder.mkdir(parents=True)
        (folder / "p.txt").write_text(lines)
    rows = files.labels(spark, str(tmp_path), "train").unionByName(files.labels(spark, str(tmp_path), "valid"))
    counts = {(r.split, r.class_id): r.instances for r in stats.class_counts(rows).collect()}
    assert counts == {("train", 0): 2, ("train", 1): 1, ("valid", 0): 1}
    assert stats.imbalanced(stats.class_counts(rows)).first().imbalanced is False


def test_metrics_and_reports(spark, tmp_path):
    (tmp_path / "m.csv").write_text("epoch, time,metrics/mAP50(B)\n1, 2.5,0.81\n2,3.5,0.5\n")
    m = files.metrics(spark, str(tmp_path / "m.csv"))
    assert m.dtypes == [("epoch", "int"), ("time", "double"), ("metrics/mAP50(B)", "double")]
    assert [r.t for r in m.select(stats.quality_tier(F.col("`metrics/mAP50(B)`")).alias("t")).collect()] == ["excellent", "fair"]
    (tmp_path / "r.json").write_text(json.dumps({"timestamp": "t", "benchmarks": {"a": {"mean_ms": 2.0, "fps": 500.0, "iterations": 3}}}, indent=1))
    assert files.report(spark, str(tmp_path / "r.json")).first().mean_ms == 2.0


def test_recognised_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"rec_texts": ["a", "", "c"], "rec_scores": [0.9, 0.0], "rec_polys": [[[0, 0], [4, 0]], [[1, 1], [2, 2]], [[5, 5], [6, 6]]]}, indent=1))
    rows = files.ocr_pages(spark, str(tmp_path / "p.json")).orderBy("idx").collect()
    assert [(r.text, r.score) for r in rows] == [("a", 0.9), ("", 0.0)]


def test_report_and_debug_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0)], "variant string, ms double")
    files.write_report(stats.latency(t, "variant", "ms"), str(tmp_path / "report"), "a")
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0].startswith("| a | 2.000") and lines[1].endswith("| 0.50x |")
    files.write_debug(spark.createDataFrame([("s1", 1), ("s2", 2)], "session_id string, n int"), str(tmp_path / "debug"))
    assert [r.n for r in files.read_debug(spark, str(tmp_path / "debug"), "s2", "n int").collect()] == [2]


def test_debug_sessions_share_folders(spark, tmp_path):
    where = tmp_path / "debug"
    odd = ["", "007", "7", "7.0", "a/b=c", "日本", "__HIVE_DEFAULT_PARTITION__"]
    rows = [(s, i, None if i % 2 else "x\ny") for s in [*map(str, range(1000, 1600)), *odd, None] for i in range(2)] + [("hot", i, "z") for i in range(5000)]
    df = spark.createDataFrame(rows, "session_id string, n int, t string").repartition(6)
    for _ in range(2):  # the second is added to the first
        files.write_debug(df, str(where))
    folders = [p for p in where.iterdir() if p.is_dir()]
    assert len(folders) <= files.DEBUG_FOLDERS and len(list(where.rglob("part-*"))) <= 4 * files.DEBUG_FOLDERS
    for s in [*odd, "1000", "1599", "hot", "none"]:
        got = files.read_debug(spark, str(where), s, "n int, t string")
        assert got.columns == ["n", "t", "session_id"]
        assert sorted(map(tuple, got.select("session_id", "n", "t").collect()), key=repr) == sorted([r for r in rows if r[0] == s] * 2, key=repr)
    assert "PartitionFilters: [isnotnull(session_bucket" in got._jdf.queryExecution().executedPlan().toString()
    assert len(files.read_debug(spark, str(where), "hot", "n int, t string").select(F.input_file_name()).distinct().collect()) <= 4
    files.write_debug(df.limit(0), str(tmp_path / "none"))
    assert files.read_debug(spark, str(tmp_path / "none"), "7", "n int, t string").count() == 0
