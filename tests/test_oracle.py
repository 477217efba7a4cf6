"""Every registered query of the library against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from logloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(str(show(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cur = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm(df.collect(), df.columns) == norm(cur.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_cartesian_product(spark):
    for name in ("w01_fixed_window", "j03_rows_by_position", "d01_next_event_scores", "a18_calibration"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
