import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from trackmotif.session import build_session

    session = build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


@pytest.fixture(scope="session")
def same():
    """Rows of a Spark and a DuckDB result, by column name, in any order."""

    def plain(x):
        if x is None or str(x) == "<NA>" or x != x:
            return None
        return x.item() if hasattr(x, "item") else x

    def rows(df):
        return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].convert_dtypes().itertuples(index=False))

    def check(got, expected):
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)

    return check
