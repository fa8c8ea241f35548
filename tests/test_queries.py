import duckdb
import pytest

import __spark_entry__ as driver
from faultlens.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(row[n]) for n in order) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tables, name):
    found = driver.queries()[name](spark, SF_DIR)
    wanted = tables.execute(driver.oracle_sql()[name])
    columns = [column[0] for column in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    rows = in_order(found.columns, found.collect())
    assert rows == in_order(columns, wanted.fetchall())
    assert rows


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["view", "heading", "key", "errors", "report_line"]
    assert result.count() == 40
