"""Every catalogue query against its SQL in another engine, over whole tables."""

import datetime
import decimal
from pathlib import Path

import pytest

from parcelflow.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
QUERIES = catalogue.all_queries()


@pytest.fixture(scope="module")
def sql():
    if not Path(DATA).exists():
        pytest.skip("no tables here")
    own = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        own.execute(f"create view {path.stem} as select * from '{path}'")
    return own


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return str(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_same_rows_as_sql(spark, sql, name):
    df = QUERIES[name].run(spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = sql.execute(QUERIES[name].sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert got == want and got


def test_entry_and_queries_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
