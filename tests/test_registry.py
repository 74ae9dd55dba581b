"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows
from registry.queries import REGISTRY


@pytest.fixture(scope="module")
def db(request):
    from conftest import SF_DIR

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert not set(REGISTRY) - set(oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, sf_dir, db, name):
    got = queries()[name](spark, sf_dir).toPandas()
    want = db.execute(oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got) == rows(want)
    assert {c: str(t) for c, t in got.dtypes.items()} == {c: str(t) for c, t in want.dtypes.items()}


def test_entry(spark):
    assert entry(spark).count() == 87
