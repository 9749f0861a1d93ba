"""The driver's queries against their SQL in DuckDB at sf0.001."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__
from tidemark import file_queries  # noqa: F401
from tidemark import queries as series

SF = Path("/root/testdata") / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shaped(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", list(series.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = series.QUERIES[name](spark, str(SF)), duck.sql(series.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert shaped(got.select(*columns).collect()) == shaped(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", [n for n in series.QUERIES if n not in series.ORACLES])
def test_query_runs(spark, name):
    assert series.QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == series.COLUMNS
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
