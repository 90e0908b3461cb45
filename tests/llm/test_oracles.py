"""Queries that SQL can express give the oracle's rows."""

import pytest

from tallyarc.llm import queries
from tests.test_oracles import oracle, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(name, spark, sf_dir, oracle):  # noqa: F811
    df = queries.QUERIES[name](spark, sf_dir)
    want = oracle.sql(queries.ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
