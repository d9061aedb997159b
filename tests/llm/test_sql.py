"""The corpus queries that SQL can express give the rows that DuckDB gives."""

import pytest

from lodevein.llm import queries as registry
from tests.test_oracle import SF, con, norm  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):  # noqa: F811
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
