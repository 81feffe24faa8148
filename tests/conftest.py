import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strandline.session import local_session

    session = local_session("tests", 8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(v):
    import pandas as pd

    if hasattr(v, "tolist"):
        return str(v.tolist())
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_value, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_sql(spark, small, duck):
    """Compares a query with its SQL by columns and rows in any order."""

    def check(query, sql):
        assert _rows(query(spark, small).toPandas()) == _rows(duck.execute(sql).df())

    return check
