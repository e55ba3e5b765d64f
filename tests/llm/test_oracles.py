"""Queries that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import queries

from ..test_catalog import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    want = c.execute(queries.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())
