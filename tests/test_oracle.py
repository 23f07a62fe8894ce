"""Every registered query equals its DuckDB oracle (the driver's gate), on
the smallest scale factor; plus the plan rules the library promises."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF_SMALL
from inkwell.sources.adapters import TABLES


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


# The warehouse's own queries; tests/llm covers those of that folder.
NAMES = sorted(contract._queries())


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(contract._oracle_sql()) | set(contract._further_oracles())
    assert set(NAMES) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF_SMALL)
    res = duck.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    s_rows = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    o_idx = [cols.index(c) for c in sorted(cols)]
    o_rows = sorted(tuple(_norm(r[i]) for i in o_idx) for r in res.fetchall())
    assert s_rows == o_rows


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["section", "count"] and df.count() == 4


@pytest.mark.parametrize("name", NAMES)
def test_no_python_in_the_plan(spark, name):
    plan = contract.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "FlatMapGroupsInPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_under_other_partition_counts(spark, name):
    """SURVEY §5(d): two runs with two shuffle widths give the same rows."""
    def run(partitions: int):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            df = contract.queries()[name](spark, SF_SMALL)
            return sorted(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run(3) == run(17)
