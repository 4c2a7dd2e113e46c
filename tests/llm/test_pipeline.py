"""The pipeline's rows against its operators' brute-force versions, and the registered queries on a small table."""

import hashlib
import os
import re

import pytest

from glyphflow.llm import decontaminate, simhash, suffixes
from glyphflow.llm import queries as registered

from plain import repeated_runs

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_and_run(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {}
    now = docs
    for name, stage in p.STAGES:
        done = stage(spark, now, DATA)
        if name != p.STAGES[-1][0]:
            assert done.columns == docs.columns
        found[name] = now = done.cache()
    kept = {r.doc_id: r.text for r in found["quality rules"].collect()}
    judged = {r.doc_id for r in registered.op1_quality_rules(spark, DATA).where("kept").collect()}
    assert set(kept) == judged
    # near-duplicates: classes by all distinct pairs
    prints = {i: simhash.fingerprint(t.encode()) for i, t in kept.items()}
    leaders = set()
    left = dict(prints)
    while left:
        i = min(left)
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            new = [b for b in left if b not in group and (prints[a] ^ prints[b]).bit_count() <= 3]
            group.update(new)
            todo += new
        leaders.add(i)
        left = {k: v for k, v in left.items() if k not in group}
    assert {r.doc_id for r in found["near-duplicates"].collect()} == leaders
    ids = sorted(leaders)
    raw = [kept[i].encode() for i in ids]
    cut = {i: suffixes.without(t, suffixes.whole_letters(t, runs)).decode() for i, t, runs in zip(ids, raw, repeated_runs(raw))}
    assert {r.doc_id: r.text for r in found["repeated passages"].collect()} == cut
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index = decontaminate.Phrases(items)
    clean = set()
    for i, t in cut.items():
        n, spans, _ = decontaminate.match([t.encode()], index)[0]
        hit = sum(b - a for a, b in spans)
        if not (hit and 20 * hit >= n):
            clean.add(i)
    assert {r.doc_id for r in found["benchmark passages"].collect()} == clean
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(registered.vocabulary())
    rows = {r.doc_id: r for r in p.run(spark, DATA).collect()}
    assert set(rows) == clean
    for i in clean:
        ids = lib.encode(cut[i], add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids) and rows[i].decoded_sha256 == hashlib.sha256(cut[i].encode()).hexdigest()


def test_run_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_queries_return_all_rows(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op9_") else ("documents", "doc_id")
    assert re.fullmatch(r"op\d+_\w+", name)
    df = registered.queries()[name](spark, DATA)
    assert sorted(r[key] for r in df.select(key).collect()) == sorted(r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())


def test_queries_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in registered.oracle_sql().items():
        df = registered.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        twin = con.execute(sql)
        names = [d[0] for d in twin.description]
        assert sorted(names) == cols
        want = sorted((tuple(r[names.index(c)] for c in cols) for r in twin.fetchall()), key=repr)
        assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
