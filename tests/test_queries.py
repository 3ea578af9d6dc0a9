"""Every registered query against its SQL, run by DuckDB on the same files."""

import duckdb
import pytest

import __spark_entry__
from rowferry.plans.derived import TABLES
from rowferry.plans.oracles import ORACLES
from rowferry.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([repr(tuple(row[i] for i in order)) for row in rows])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, rows = sorted_rows(df.columns, df.collect())
    assert rows
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        assert (columns, rows) == sorted_rows(expected.columns, expected.fetchall())


def test_all_have_oracles():
    assert set(ORACLES) == set(QUERIES)


def test_all_are_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 500
    assert [row.revenue for row in rows] == sorted((row.revenue for row in rows), reverse=True)
    assert not any(row.truncated for row in rows)


@pytest.mark.parametrize("name", ["group_options", "page_index", "concat_lines", "audit_unique", "dict_columns"])
def test_partition_count_does_not_matter(spark, name):
    results = []
    for partitions in ("3", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            df = QUERIES[name](spark, SF_DIR)
            results.append(sorted_rows(df.columns, df.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
