"""Operators against their whole entries in the survey, on values spelt out here."""

import duckdb
import pytest

from quaystone.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_names_are_cut_at_trading_names(spark):
    cases = {"ALPHA LTD T/A BETA": "ALPHA", "Alpha Limited trading  as Beta Ltd": "ALPHA", "Alpha (UK) Ltd, formerly Beta": "ALPHA", "Alpha t / a": "ALPHA", "T/A Beta": "", "Formerlys Ltd": "FORMERLYS", "GREAT/A Ltd": "GREAT A", "A T/A B T/A C\nD": "A"}
    spark.createDataFrame([(k,) for k in cases], "n string").createOrReplaceTempView("names")
    engine = duckdb.connect()
    engine.sql("create table names (n varchar)")
    engine.executemany("insert into names values (?)", [(k,) for k in cases])
    assert {r.n: r.x for r in spark.sql(f"select n, {catalogue.name(catalogue.Spark, 'n')} as x from names").collect()} == cases
    assert dict(engine.sql(f"select n, {catalogue.name(catalogue.Duck, 'n')} as x from names").fetchall()) == cases


def test_amounts_in_brackets_are_negative(spark):
    cases = {"(10)": -10.0, " (£1,250.50) ": -1250.5, "£1,250.50": 1250.5, "": None, "bad": None, "1 000": None, "-3": -3.0}
    spark.createDataFrame([(k,) for k in cases], "a string").createOrReplaceTempView("amounts")
    engine = duckdb.connect()
    engine.sql("create table amounts (a varchar)")
    engine.executemany("insert into amounts values (?)", [(k,) for k in cases])
    assert {r.a: r.x for r in spark.sql(f"select a, {catalogue.amount(catalogue.Spark, 'a')} as x from amounts").collect()} == cases
    assert dict(engine.sql(f"select a, {catalogue.amount(catalogue.Duck, 'a')} as x from amounts").fetchall()) == cases


def test_capacities_lift_and_recall(spark):
    labels = sorted(((r.doc_id * 37 % 100 + 0.5) / -100, r.doc_id, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect())
    n, positives = len(labels), sum(y for *_, y in labels)
    rows = {r.fraction: r for r in catalogue.QUERIES["capacity_metrics"](spark, DATA).collect()}
    assert sorted(rows) == [0.01, 0.02, 0.05, 0.1, 0.2]
    for f, r in rows.items():
        k = max(1, -int(-n * f // 1))
        hits = sum(y for *_, y in labels[:k])
        assert (r.k, r.hits) == (k, hits)
        assert (r.lift, r.recall) == pytest.approx((hits / k / (positives / n), hits / positives), abs=1e-8)


def test_age_basis_and_overall_agreement(spark):
    for r in catalogue.QUERIES["age_basis_features"](spark, DATA).limit(50).collect():
        assert (r.cubed, r.knot24, r.knot36) == pytest.approx(((r.months / 48) ** 3, (max(r.months - 24, 0) / 48) ** 3, (max(r.months - 36, 0) / 48) ** 3), abs=1e-7)
    rows = {r.arm: r for r in catalogue.QUERIES["reviewer_agreement_kappa"](spark, DATA).collect()}
    assert rows["overall"].n == sum(r.n for arm, r in rows.items() if arm != "overall") > 0
