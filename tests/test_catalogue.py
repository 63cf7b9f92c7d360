"""Every query against the SQL stated for it."""

import duckdb
import pytest

from quaystone.plans import catalogue, library

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in found], key=repr)


@pytest.mark.parametrize("key", sorted(library.ORACLES))
def test_matches_sql(spark, key):
    found = library.QUERIES[key](spark, DATA)
    columns = sorted(found.columns)
    engine = duckdb.connect()
    for table in catalogue.TABLES:
        engine.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    expected = engine.sql(f"select {', '.join(columns)} from ({library.ORACLES[key]}) q").fetchall()
    assert rows(map(tuple, found.select(*columns).collect())) == rows(expected)


@pytest.mark.parametrize("key", ["validation_sample", "content_fingerprint", "logistic_scores", "isotonic_calibration", "platt_calibration", "calibration_slope", "feature_effects"])
def test_runs_without_sql(spark, key):
    found = library.QUERIES[key](spark, DATA).collect()
    assert found and not any(v is None for v in found[0][:2])


def test_user_views_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    library.QUERIES["lag_and_age"](spark, DATA).count()
    assert spark.table("orders").count() == 3
