"""Every registered query with SQL gives the SQL's rows; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from quillstone.plans import catalog, derived, inline

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = {**catalog.QUERIES, **derived.QUERIES, **inline.QUERIES}, {**catalog.SQL, **derived.SQL, **inline.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x != x:
        return "-"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    try:
        return f"{float(x):.6f}"
    except (TypeError, ValueError):
        return str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(frame) > 0
        return
    assert rows_of(frame) == rows_of(duck.execute(SQL[name]).df())
