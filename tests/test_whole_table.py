"""The layout queries over all of events, at a size where a cut at 1000 rows shows, and with a short last row."""

import duckdb
import pytest

from gneiss.plans import catalog

NAMES = sorted([*catalog.WHOLE, "take_wrap"])


def compare(spark, sf, name):
    db = duckdb.connect()
    for table in ("events", "nation"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), db.sql(catalog.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (d[cols].astype("float64").sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert ((a - b).abs() <= 2e-3 + 1e-9 * b.abs()).all().all()
    return got


@pytest.mark.parametrize("name", NAMES)
def test_ten_thousand_events(spark, name):
    got = compare(spark, "/root/testdata/sf0.01", name)
    if name == "ravel":
        assert len(got) == 10_000
    if name == "take_wrap":
        assert got.set_index("n_nationkey").event_id[0] == 9950


@pytest.mark.parametrize("name", NAMES)
def test_short_last_row(spark, tmp_path, name):
    read = lambda table: spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    read("events").filter("event_id < 1003").select("event_id", "event_type", "value").toPandas().to_parquet(f"{tmp_path}/events.parquet")
    read("nation").toPandas().to_parquet(f"{tmp_path}/nation.parquet")
    got = compare(spark, str(tmp_path), name)
    if name == "ravel":
        assert len(got) == 26 * 40
