"""Every core query runs, and the ones with SQL give its rows."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from umbra.plans.queries import QUERIES, SQL



def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 5)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def tables(folder):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for file in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, tables, name):
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name in SQL:
        result = tables.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
