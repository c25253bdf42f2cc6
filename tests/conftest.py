import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{f}')")
    return con


def plain(v):
    import datetime

    if isinstance(v, float):
        return "null" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return "null" if v is None else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL on the smallest tables."""

    def check(query, sql):
        cols, got = rows_of(query(spark, SMALL))
        rel = duck.sql(sql)
        names = rel.columns
        want = sorted("|".join(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall())
        assert sorted(names) == cols
        assert got == want

    return check
