"""Every registered query of the library proper against its SQL in another engine, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from chainrollup.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Each third query runs here, for time; with ALL_QUERIES set in the environment all of them do.
NAMES = list(ORACLES) if os.environ.get("ALL_QUERIES") else list(ORACLES)[::3]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def canon(cols, rows):
    def one(x):
        if isinstance(x, float):
            return f"{x + 0.0:.6f}"
        return str(int(x)) if isinstance(x, decimal.Decimal) and x == int(x) else x.isoformat() if isinstance(x, datetime.date) else str(x)

    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(tuple(one(r[k]) for k in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_matches(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert canon(got.columns, got.collect()) == canon(cols, cur.fetchall())


def test_plans_run_no_python(spark):
    for name in ("kpi", "rollup", "job_rollup", "concentration_over_time"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
