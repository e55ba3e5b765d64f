"""Every registered query against its SQL form in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tessera import catalog

ENTRIES = catalog.entries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def text(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "uint")):
        return f"{float(v):.9g}"
    return str(v)


def rows(columns: list[str], data) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_same_as_sql(spark, sf_dir, duck, name):
    query, sql = ENTRIES[name]
    df = query(spark, sf_dir)
    found = rows(df.columns, df.collect())
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert found == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql])
def test_runs_without_sql(spark, sf_dir, name):
    assert ENTRIES[name][0](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["agg_distinct", "agg_hll"])
def test_sketches_are_not_kept_for_each_distinct_value(spark, tmp_path, name):
    rows = [(None if i % 3 == 0 else "AB"[i % 2], None if i % 11 == 0 else i) for i in range(3000)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = ENTRIES[name][0](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    sketched = [line for line in plan.splitlines() if "Aggregate" in line and ("approx_count_distinct" in line or "hll_sketch_agg" in line)]
    assert sketched and not any("count(distinct" in line for line in sketched)
    assert {tuple(r) for r in df.collect()} == {(None, True), ("A", True), ("B", True)}
