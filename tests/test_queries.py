"""Every registered query of the page-text engine against its SQL twin, run by DuckDB."""

import math
import os

import duckdb
import pytest

from glyphflow import catalog
from glyphflow.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(found, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    own = rows(df.select(*cols).collect(), range(len(cols)))
    if name not in catalog.oracle_sql():
        assert own
        return
    twin = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == cols
    assert own == rows(twin.fetchall(), [names.index(c) for c in cols])
