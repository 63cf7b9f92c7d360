"""The decision tables of linkage, name periods and samples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaystone.operators import linkage, sampling
from quaystone.operators.checks import DataError

INC = dt.date(2010, 1, 1)
COMPANY = "company_number string, company_name string, postcode string, incorporation_date date, former_names array<struct<raw_name:string,change_date:date>>, CompanyStatus string"


def companies(spark, rows):
    return spark.createDataFrame([(n, name, pc, inc, former, "Active") for n, name, pc, inc, former in rows], COMPANY)


def judgments(spark, rows):
    return spark.createDataFrame([(i, d, c, t, p, "Corporate", "England and Wales") for i, d, c, t, p in rows], "ID string, JudgmentDate date, company_name string, trading_name string, postcode string, DefendantType string, Jurisdiction string")


def decided(spark, js, cs):
    return {r["ID"]: r for r in linkage.match(judgments(spark, js), companies(spark, cs), snapshot=("CompanyStatus",)).collect()}


def test_only_unique_names_link_and_postcodes_never_choose(spark):
    day = dt.date(2024, 1, 1)
    js = [("EXACT", day, "Alpha Ltd.", "", "aa1 1aa"), ("TRAP", day, "Omega Trading Ltd", None, "BB1 1BB"), ("OTHER", day, "Gamma Ltd", "", "ZZ1 1ZZ"), ("TWO", day, "Delta Limited", "", "YY1 1YY"), ("TRADE", day, "Unrelated Style", "Trader Ltd", "TT1 1TT"), ("NOPC", day, "Epsilon Limited", "", ""), ("CONFLICT", day, "Alpha Ltd", "Gamma Ltd", "AA1 1AA"), ("NOINC", day, "Blocker Limited", "", "BL1 1BL"), ("HISTORY", day, "History Blocker Limited", "", "HB1 1HB"), ("NONE", day, " (x) ", None, "AA1 1AA")]
    cs = [("1", "ALPHA LIMITED", "AA1 1AA", INC, []), ("2", "OMEGA TRADING SERVICES LIMITED", "BB1 1BB", INC, []), ("4", "GAMMA LIMITED", "GG1 1GG", INC, []), ("5", "DELTA LTD", "YY1 1YY", INC, []), ("6", "DELTA LIMITED", "DE1 1DE", INC, []), ("7", "TRADER LIMITED", "TT1 1TT", INC, []), ("8", "EPSILON LIMITED", "EE1 1EE", INC, []), ("9", "BLOCKER LIMITED", "BL1 1BL", INC, []), ("10", "BLOCKER LTD", "BX1 1BX", None, []), ("11", "HISTORY BLOCKER LIMITED", "HB1 1HB", INC, []), ("12", "HISTORY BLOCKER LTD", "HX1 1HX", INC, [("OLDER HISTORY BLOCKER LIMITED", None)])]
    found = decided(spark, js, cs)
    accepted = {"EXACT": ("1", "company_name", "unique_exact_name_postcode_agrees"), "OTHER": ("4", "company_name", "unique_exact_name_postcode_differs"), "TRADE": ("7", "trading_name", "unique_exact_name_postcode_agrees"), "NOPC": ("8", "company_name", "unique_exact_name_postcode_missing")}
    for i, r in found.items():
        assert (r["matched_company_number"], r["matched_on"], r["reason"]) == accepted[i] if i in accepted else r["tier"] == "unmatched", i
    assert found["EXACT"]["postcode_agrees"] and not found["OTHER"]["postcode_agrees"] and found["EXACT"]["CompanyStatus"] == "Active" and found["TRAP"]["CompanyStatus"] is None
    assert {i: found[i]["reason"] for i in ("TRAP", "TWO", "CONFLICT", "NOINC", "HISTORY", "NONE")} == {"TRAP": "no_date_valid_unique_exact_name", "TWO": "exact_name_not_uniquely_verifiable", "CONFLICT": "exact_name_not_uniquely_verifiable", "NOINC": "exact_name_not_uniquely_verifiable", "HISTORY": "exact_name_not_uniquely_verifiable", "NONE": "missing_name"}
    assert found["TWO"]["exact_name_candidate_count"] == found["CONFLICT"]["exact_name_candidate_count"] == 2
    assert found["NOINC"]["incorporation_date_missing"] and found["HISTORY"]["name_history_incomplete"]


def test_former_names_and_incorporation(spark):
    js = [("FORMER", dt.date(2020, 6, 1), "Old Echo Limited", "", "EE1 1EE"), ("CURRENT", dt.date(2022, 6, 1), "New Echo Limited", "", "x"), ("EARLY", dt.date(2020, 6, 1), "New Echo Limited", "", "x"), ("LATE", dt.date(2022, 6, 1), "Old Echo Limited", "", "x"), ("CHANGE", dt.date(2021, 1, 1), "Old Echo Limited", "", "x"), ("PREINC", dt.date(2010, 1, 1), "Future Limited", "", "x"), ("ONINC", dt.date(2011, 1, 1), "Future Limited", "", "x"), ("NOINC", dt.date(2024, 1, 1), "No Date Limited", "", "x"), ("INCOMPLETE", dt.date(2024, 1, 1), "Incomplete New Limited", "", "x")]
    cs = [("1", "NEW ECHO LIMITED", "EE1 1EE", INC, [("OLD ECHO LIMITED", dt.date(2021, 1, 1))]), ("2", "FUTURE LIMITED", "FF1 1FF", dt.date(2011, 1, 1), []), ("3", "NO DATE LIMITED", "NN1 1NN", None, []), ("4", "INCOMPLETE NEW LIMITED", "II1 1II", INC, [("INCOMPLETE OLD LIMITED", None)])]
    found = decided(spark, js, cs)
    assert {i for i, r in found.items() if r["tier"] == "exact_unique"} == {"FORMER", "CURRENT", "ONINC"}
    assert found["FORMER"]["matched_name_kind"] == "former" and found["FORMER"]["matched_name"] == "OLD ECHO LIMITED" and found["CURRENT"]["matched_name_kind"] == "current"
    assert found["PREINC"]["rejected_post_incorporation"] == 1 and found["PREINC"]["reason"] == "exact_name_post_incorporation"
    assert found["NOINC"]["reason"] == "exact_name_missing_incorporation_date" and found["INCOMPLETE"]["reason"] == "exact_name_incomplete_name_history"
    assert found["CHANGE"]["reason"] == found["EARLY"]["reason"] == "no_date_valid_unique_exact_name"


def test_periods_count_bad_changes(spark):
    table = companies(spark, [("1", "Now Ltd", "", INC, [("C", dt.date(2015, 1, 1)), ("B", dt.date(2012, 1, 1)), ("A", dt.date(2012, 1, 1)), ("Z", INC), ("Y", None), ("Ltd", None)])])
    periods, history = linkage.name_periods(table)
    rows = [(r["name"], r["valid_from"], r["valid_to"], r["kind"]) for r in periods.orderBy("valid_from").collect()]
    assert rows == [("A", INC, dt.date(2012, 1, 1), "former"), ("C", dt.date(2012, 1, 1), dt.date(2015, 1, 1), "former"), ("NOW", dt.date(2015, 1, 1), None, "current")]
    assert tuple(history.first()) == ("1", 1, 2)


def test_conflicting_companies_raise(spark):
    rows = [("1", "A", "x", INC, []), (" 1", "A", "x", INC, []), ("", "B", "x", INC, [])]
    assert linkage.deduplicated(companies(spark, rows)).count() == 1
    with pytest.raises(DataError):
        linkage.deduplicated(companies(spark, [*rows, ("1", "B", "x", INC, [])]))
    one = judgments(spark, [("J", dt.date(2024, 1, 1), "A", "", "")])
    with pytest.raises(DataError):
        linkage.match_checked(one.union(one), companies(spark, rows))
    assert linkage.candidate_companies(companies(spark, [("1", "A Ltd", "", INC, []), ("2", "B", "", INC, [("A", None)]), ("3", "C", "", INC, [])]), one).count() == 2


def decisions(spark, n):
    ids = spark.range(n).select(F.format_string("J-%04d", "id").alias("ID"), F.col("id").alias("k"))
    js = ids.select("ID", F.to_date(F.format_string("%d-01-01", F.lit(2020) + F.col("k").cast("int") % 3)).alias("JudgmentDate"), F.lit("Corporate").alias("DefendantType"), F.lit("England and Wales").alias("Jurisdiction"))
    tier = F.when(F.col("k") % 4 == 0, "unmatched").otherwise("exact_unique")
    ds = ids.select("ID", tier.alias("tier"), F.when(F.col("k") % 8 == 0, "missing_name").otherwise("r").alias("reason"), F.col("k").cast("string").alias("matched_company_number"), F.lit("M").alias("matched_company_name"), F.lit("P").alias("matched_company_postcode"), F.lit("N").alias("matched_name"), F.lit("current").alias("matched_name_kind"), F.lit("company_name").alias("matched_on"), (F.col("k") % 2 == 0).alias("postcode_agrees"), F.lit(0).alias("rejected_post_incorporation"), F.lit(False).alias("incorporation_date_missing"), F.lit(False).alias("name_history_incomplete"), F.lit(0).alias("exact_name_candidate_count"), F.lit("S").alias("source_company_name"), F.lit("T").alias("source_trading_name"), F.lit("Q").alias("source_postcode"), F.lit(None).cast("date").alias("IncorporationDate"))
    return js, ds


def test_diagnostics(spark):
    js, ds = decisions(spark, 400)
    found = linkage.diagnostics(js, ds)
    assert [tuple(r) for r in found["tier_counts"].collect()] == [("exact_unique", 300, 0.75), ("unmatched", 100, 0.25)]
    assert {r["reason"]: r["rows"] for r in found["unmatched_reasons"].collect()} == {"missing_name": 50, "r": 50}
    assert all("ID" not in t.columns for t in found.values()) and found["guard_counts"].count() == 4
    with pytest.raises(DataError):
        linkage.diagnostics(js, ds.where("ID <> 'J-0001'"))
    assert {r["stage"]: r["rows"] for r in linkage.matching_funnel(js, ds, ds.limit(3), ds.limit(2)).collect()} == {"judgments_read": 400, "matching_decisions": 400, "unique_exact_name": 300, "unmatched": 100, "accepted_validation_sample": 3, "unmatched_validation_sample": 2}


def test_samples_against_a_plain_draw(spark):
    import hashlib

    js, ds = decisions(spark, 400)
    rows = [r.asDict() | {"year": d.year} for r, d in zip(ds.orderBy("ID").collect(), [x["JudgmentDate"] for x in js.orderBy("ID").collect()], strict=True)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    linked = sorted((r for r in rows if r["tier"] == "exact_unique"), key=lambda r: ("|".join(map(str, (r["matched_on"], r["matched_name_kind"], r["reason"], r["postcode_agrees"], r["year"]))), sha(f"73|exact_unique|{r['ID']}|{r['matched_company_number']}")))
    start, step = int(sha("73|exact_unique|systematic-start")[:16], 16) / 2**64, len(linked) / 70
    want = {linked[int((start + i) * step)]["ID"] for i in range(70)}
    found = sampling.accepted_sample(js, ds, 70, 73)
    assert {r["ID"] for r in found.collect()} == want and len(want) == 70
    assert found.first()["inclusion_probability"] == 70 / 300
    by_stratum = {}
    for r in rows:
        if r["tier"] == "unmatched":
            by_stratum.setdefault(f"reason={r['reason']}|judgment_year={r['year']}", []).append(r["ID"])
    sizes = sampling.allocate({k: len(v) for k, v in by_stratum.items()}, 20)
    want = {i for k, ids in by_stratum.items() for i in sorted(ids, key=lambda i: sha(f"73|unmatched|{k}|{i}|"))[: sizes[k]]}
    drawn = sampling.unmatched_sample(js, ds, 20, 73)
    assert {r["ID"] for r in drawn.collect()} == want and sum(sizes.values()) == 20 and min(sizes.values()) >= 1
    assert drawn.agg(F.sum("sampling_weight")).first()[0] == pytest.approx(100)
    both = sampling.validation_sample(js, ds, 70, 20, 73)
    assert both.count() == 90 and both.where("matched_company_number IS NULL").isEmpty()
    assert sampling.unmatched_sample(js, ds, 1000, 73).where("sampling_weight <> 1").isEmpty()
    for bad in (lambda: sampling.pair_sample(js, ds, 301, 1), lambda: sampling.unmatched_sample(js, ds, 0, 1), lambda: sampling.allocate({"a": 5, "b": 5}, 1), lambda: sampling.require_no_outcomes(ds.withColumn("Judgment Status", F.lit(1)))):
        with pytest.raises(DataError):
            bad()
    assert sampling.allocate({"b": 3, "a": 1, "c": 96}, 10) == {"a": 1, "b": 1, "c": 8}
