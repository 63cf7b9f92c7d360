"""Days since a prior order against brute force, on either side of 24 months."""

from datetime import datetime

from quaystone.plans import catalogue


def test_prior_orders_older_than_24_months_do_not_count(spark, tmp_path):
    days = ["1994-02-28", "1996-02-29", "1996-02-29", "1998-02-27", "1998-03-01", "2000-03-02"]
    rows = [(i, 1, "F", 1.0, datetime.fromisoformat(x), "p") for i, x in enumerate(days)] + [(9, 2, "F", 1.0, datetime(1995, 1, 1), "p")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.o_orderkey: r.days_since for r in catalogue.QUERIES["days_since_prior"](spark, str(tmp_path)).collect()}
    assert found == {0: None, 1: 731, 2: 731, 3: 729, 4: 2, 5: None, 9: None}
