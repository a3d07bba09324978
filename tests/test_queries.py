"""Every query against its SQL on the smallest tables: columns, types of values and rows in any order."""

import math
import os

import duckdb
import pytest

from typegrove import history_queries, model_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(queries.FOUND))
def test_query(spark, duck, name):
    got = queries.FOUND[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(norm, got.select(*columns).collect()), key=repr)
    if name not in queries.SQL:
        assert rows
        return
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((norm([r[i] for i in order]) for r in want.fetchall()), key=repr)


def test_flagship_plan_prunes_other_tables(spark):
    """A filter on one type reads one table, and only its columns."""
    plan = queries.FOUND["filter_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "c_acctbal" in plan and "c_nationkey" not in plan
