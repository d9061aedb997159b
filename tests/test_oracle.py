"""Every registered graph query with SQL gives the rows that DuckDB gives."""

import math
import os

import pytest

from lodevein import model_queries, queries, weight_queries

QUERIES = {**queries.queries(), **model_queries.queries(), **weight_queries.queries()}
SQL = {**queries.oracle_sql(), **model_queries.oracle_sql(), **weight_queries.oracle_sql()}
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want
