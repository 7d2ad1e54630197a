"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries of the packages that tests/ covers; those of opinark.llm have their own tests.
NAMES = sorted(n for n in QUERIES if n in SQL and not n.startswith("p"))
OTHERS = sorted(n for n in QUERIES if n not in SQL and not n.startswith("p"))

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", OTHERS)
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() > 0
