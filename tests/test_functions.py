"""Column functions against values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaystone.functions import dates, features, text


def values(spark, rows, function, kind="string"):
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in table.select("i", function(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_names(spark):
    cases = {
        "A&B, Ltd.": "A AND B",
        "Limited Edition Designs Ltd": "LIMITED EDITION DESIGNS",
        "Example Ltd (in liquidation)": "EXAMPLE",
        "Alpha LLC": "ALPHA",
        "Gamma Corporation": "GAMMA CORPORATION",
        "Foo Ltd T/A Bar": "FOO",
        "Foo trading  as Bar Ltd": "FOO",
        "Café Noir Ltd": "CAFE NOIR",
        "JOE’S": "JOES",
        "JOE'S": "JOE S",
        "ﬁrst № ①": "FIRST NO 1",
        "X in administration PLC": "X",
        "LTD": "",
        None: "",
    }
    assert values(spark, list(cases), text.normalize_name) == list(cases.values())


def test_codes_amounts_and_dates(spark):
    assert values(spark, [" England & Wales", "SCOTLAND", "Wales", None], lambda c: text.decoded(c, {"england and wales": "E", "scotland": "S"})) == ["E", "S", None, None]
    assert values(spark, ["£1,250.50", "(10)", "", "bad", "1d", "nan", None], text.parse_amount) == [1250.5, -10.0, None, None, None, None, None]
    assert values(spark, ["£1", "", "bad", "nan", None], text.amount_is_invalid) == [False, False, True, True, False]
    assert values(spark, ["03/01/2024", "2024-01-03T09:00", "31/02/2024", "", "3 Jan 2024"], dates.parse_date) == [dt.date(2024, 1, 3), dt.date(2024, 1, 3), None, None, dt.date(2024, 1, 3)]
    assert dates.observation_day("03/01/2024") == dates.observation_day(dt.datetime(2024, 1, 3, 5)) == dt.date(2024, 1, 3)
    with pytest.raises(ValueError):
        dates.observation_day("soon")
    assert values(spark, [" sc 1234 ", None], text.clean_company_number) == ["SC1234", ""]
    assert values(spark, [dt.date(2024, 3, 31)], lambda c: dates.months_before(c, 1), "date") == [dt.date(2024, 2, 29)]


def test_bands_and_features(spark):
    edge = [0.0, 499.99, 500.0, 25000.0, None]
    assert values(spark, edge, lambda c: features.band(c, *features.AMOUNT_BANDS, missing="amount_missing"), "double") == ["under_500", "under_500", "500_999", "25000_plus", "amount_missing"]
    assert values(spark, [1.0, 12.0, 12.1, 48.0, 48.1, None], lambda c: features.right_closed_band(c, *features.AGE_BANDS), "double") == ["outside_or_missing", "over_1_to_12", "over_12_to_24", "over_36_to_48", "outside_or_missing", "outside_or_missing"]
    basis = values(spark, [730], lambda c: F.array(*features.age_basis(c).values()), "int")[0]
    months = 730 / (365.25 / 12)
    assert basis == pytest.approx([months, (months / 48) ** 2, (months / 48) ** 3, ((months - 12) / 48) ** 3, 0, 0])
    days = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2023, 1, 1)), (dt.date(2024, 1, 1), None), (dt.date(2024, 1, 1), dt.date(2025, 1, 1))], "d date, s date")
    assert [r[0] for r in days.select(features.history_coverage(F.col("d"), F.col("s"))).collect()] == pytest.approx([365 / 730, 0, 0])
    assert values(spark, [-1.0, None, 4.0], lambda c: features.amount_features(c)["judgment_amount_missing"], "double") == [1, 1, 0]
    snapshot = spark.createDataFrame([("4", "1", dt.date(2026, 1, 1), " Active"), ("0", "", None, "Dissolved"), ("", "", None, None)], "c string, p string, due date, status string")
    found = snapshot.select(*(v.alias(k) for k, v in features.snapshot_features(F.col("c"), F.col("p"), F.col("due"), F.lit(dt.date(2026, 6, 1)), F.col("status")).items())).collect()
    assert [tuple(r) for r in found] == [(1.0, 4.0, 0.25, 1.0, 1.0), (0.0, 0.0, 0.0, None, 0.0), (None, None, None, None, None)]
    assert values(spark, [0, 9, 10, 1234], lambda c: features.masked_count(c, 10), "int") == ["<10", "<10", "10", "1,234"]
    assert values(spark, [0, 9, 10], lambda c: features.redacted_count(c, 10), "int") == [0, None, 10]
