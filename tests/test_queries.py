"""Every registered query of the library against its SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    got = sorted(str([plain(row[x]) for x in names]) for row in df.collect())
    result = duck.execute(registry.SQL[name])
    order = [x[0] for x in result.description]
    assert sorted(order) == names
    want = sorted(str([plain(row[order.index(x)]) for x in names]) for row in result.fetchall())
    assert got == want
