"""Every registered query of the catalogue against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from plumbline.plans import catalogue, every  # noqa: F401  every registers all queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=str)


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return float(value) if type(value).__name__ in ("int", "Decimal") and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf)
    rows = found.collect()
    assert rows
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(found.columns)
        assert _rows(found.columns, rows) == _rows(columns, want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
