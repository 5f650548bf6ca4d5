"""Queries against DuckDB at sf0.001, where their answers are exact after rounding."""

import glob
import os

import pytest

from gneiss.plans import catalog

SF = "/root/testdata/sf0.001"
#: One step of the coarsest rounding that queries of small values use.
STEP = 1.1e-6


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_duckdb(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert (a[c].isna() == b[c].isna()).all(), c
            known = a[c].notna()
            assert ((a[c] - b[c])[known].abs() <= 1e-6 * b[c][known].abs().clip(lower=1.0) + STEP).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
