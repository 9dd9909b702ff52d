"""Every query of the core against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import lithocube.plans.problem_queries  # noqa: F401
import lithocube.plans.engine_queries  # noqa: F401
from lithocube.plans.registry import QUERIES, SQL

NAMES = sorted(n for n in QUERIES if not QUERIES[n].__module__.startswith("lithocube.llm"))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got
        # Lost executors run their tasks again, so a result must be the same every time.
        assert got == sorted(repr(tuple(map(plain, r))) for r in QUERIES[name](spark, data).select(*columns).collect())
        return
    sql = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert sorted(duck.sql(SQL[name]).columns) == columns
    assert got == sorted(repr(tuple(map(plain, r))) for r in sql.fetchall())
