"""Every query with a SQL twin against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodespark.plans import catalogue

D = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        name, at = f.removesuffix(".parquet"), f"{D}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def key(row):
    return tuple((x is None, str(x)) if not isinstance(x, float) else (False, f"{x:.3f}") for x in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    if name in ("graph_girvan_newman", "stack_predict", "third_predict") and not os.environ.get("SLOW_TESTS"):
        pytest.skip("minutes long; run with SLOW_TESTS=1")
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert len(set(columns)) == len(columns)
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(g, w, strict=True)), (g, w)
