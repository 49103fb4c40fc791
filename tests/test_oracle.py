"""Every query with SQL gives the rows of its oracle; the others run and have their columns."""

import duckdb
import numpy as np
import pytest

from seamark.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns, key=lambda c: (str(want[c].dtype).startswith("float"), c))
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        if str(want[c].dtype).startswith("float"):
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


SLOW = {"v1_kmeans_knots", "a3_coarse_grid"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
