"""The queries that SQL can express against their twins, on the small tables and on edge rows."""

import os
import random
from collections import Counter

import duckdb
import pytest

from glyphflow.llm import licenses, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    rng = random.Random(17)
    word = lambda: rng.choice(["the", "Éclair", "MIT", "license", "cc", "by", "日本", "x1", "a-b", "don't"])
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(60)
    items = [(k, line(rng.choice([1, 2, 13, 20]))) for k in range(8)] + [(8, None), (8, ""), (9, passage), (2, line(15)), (None, passage), (None, line(14))]
    texts = [None, "", " \t\n", "one", "x" * 30_000, "a b " * 5_000, "é" * 300, "gnu gnu general public license public license", "CC-BY 4.0 cc by"]
    texts += [line(n) + passage + line(n) for n in (0, 5, 200, 2000)] + [passage] * 5 + [items[6][1] + " " + line(9)]
    for _, key, t in licenses.TEMPLATES:
        texts += [t, f"{key} {line(30)}", f"{line(4)} {key} {key} {t}", " ".join(t.split()[2:])]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[12], docs[12], (None, line(40), None, None, None)]
    urls = [None, "", "none", "http://Example.ORG/es/x?y#z", "https://a.example.org/en/12", "http://xexample.org/es/", "http://x.com/de/1", "http://org", "http://org?/", "http://m.ads-track.example.net/a", "http://ads.x.net?ads", "http://a.net/b/login", "http://a.net/login2", "http://a.net/LOGIN", "http://a.net/x#/login", "x://y://z.com/de/", "http://com:80/de/", "http://poker.com/de/", "http://xxx.a.com/fr/1", "http://ñads.net/", "http://a.net/ads/", "http://tracker.poker.net/cart/checkout", "http://blog.casino-win.example.net/", "http://casino-winner.net/", "http://my-casino-win.net/", "http://casino-help.net/login", "http://ads-1.x.net/a/CLICK/", "http://x.net/ads/img/1", "http://x.net/ads/image/", "http://x.net/cart%20", "http://x.net/cart~", "http://poker.x.net/a/help/", "http://x.net/" + "ads/img/" * 4000]
    where = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string").coalesce(1).write.parquet(f"{where}/pages.parquet")
    return where


def compare(spark, name, where):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        path = f"{where}/{t}.parquet"
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    twin = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    df = queries.queries()[name](spark, where)
    assert sorted(df.columns) == sorted(names)
    got, want = Counter(map(tuple, df.select(*names).collect())), Counter(twin.fetchall())
    assert got == want and want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin_on_edge_rows(spark, edge_dir, name):
    compare(spark, name, edge_dir)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin_on_the_small_tables(spark, name):
    compare(spark, name, DATA)
