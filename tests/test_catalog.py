"""Every registered query of the retrieval engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loamline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return out


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    frame = catalog.queries()[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(frame.columns)]) for r in frame.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in found.fetchall())


def test_plans_broadcast_only_small_sides_and_push_filters(spark):
    plan = catalog.queries()["R3_bm25"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan
