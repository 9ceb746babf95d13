"""Every registered query against its SQL text, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from vulnlake.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = {name: run for name, run in contract.queries().items() if name in catalog.QUERIES}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        return round(float(value), 6) if isinstance(value, (int, float)) else value

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(catalog.ORACLES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert normal(result.columns, [tuple(r) for r in result.collect()]) == normal(
        columns, expected.fetchall()
    )


def test_every_event_is_emitted(spark, duck):
    rows = QUERIES["event_emit_all"](spark, SF_DIR)
    assert rows.select("type").distinct().count() == 7
    assert rows.count() == duck.execute("SELECT count(*) FROM events").fetchone()[0]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
