import os

import duckdb
import pytest

pytest.importorskip("lithocube.llm")
import lithocube.llm.queries  # noqa: E402, F401
from lithocube.plans.registry import QUERIES, SQL  # noqa: E402

NAMES = sorted(n for n in QUERIES if QUERIES[n].__module__.startswith("lithocube.llm"))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got
    if name in SQL:
        con = duckdb.connect()
        for t in os.listdir(data):
            con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{data}/{t}'")
        assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()))
