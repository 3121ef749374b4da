"""Every query with an oracle, side by side with DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest
from conftest import SF

from tessera import catalog


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]
    told = duck.sql(catalog.ORACLES[name])
    assert sorted(told.columns) == cols
    theirs = [tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()]
    assert sorted(ours, key=str) == sorted(theirs, key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
