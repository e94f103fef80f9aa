"""Queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from granula.plans import registry
from tests.conftest import SF

NAMES = [name for name, (_, sql) in registry.ALL.items() if sql]


@pytest.fixture(scope="module")
def view(spark):
    """One view for all queries: the tables that several share are written once."""
    return registry.View(spark, SF)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "supplier", "part", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def key(rows):
    return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(view, con, name):
    make, sql = registry.ALL[name]
    df = registry.rounded(make(view))
    cols = sorted(df.columns)
    got = key(df.select(cols).collect())
    want = key(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    assert got == want


def test_every_query_has_unique_name_and_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
