"""Disclosure control, reports and the single-use release."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quaystone.operators import disclosure, release, reports
from quaystone.operators.checks import DataError


def test_small_cells(spark):
    table = spark.createDataFrame([("a", 0, 10), ("b", 9, 10), ("c", 10, 0), ("d", 10, 1)], "k string, n int, m int")
    assert [r["k"] for r in disclosure.suppress_small_cells(table, ["n", "m"]).collect()] == ["a", "c"]
    for bad in (lambda: disclosure.suppress_small_cells(table, ["x"]), lambda: disclosure.suppress_small_cells(table.withColumn("n", F.lit(-1)), ["n"]), lambda: disclosure.suppress_small_cells(table.withColumn("n", F.lit("x")), ["n"])):
        with pytest.raises(DataError):
            bad()


def test_headings_and_values(spark):
    marked = [h for h in ("Company Name", "metric_name", "run_id", "Judgment-ID", "Postcode area", "Home address", "share", "defendant full name", "file name") if disclosure.is_identifying(h)]
    assert marked == ["Company Name", "Judgment-ID", "Postcode area", "Home address", "defendant full name"]
    texts = ["at AB1 2CD now", "gir0aa", "SC123456", "Company No.: 12345678", "alpha beta Ltd.", "in Quay-77 it", "year 2024 ltdx", "XAB1 2CDX", "12345678"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*(v.alias(k) for k, v in disclosure.value_flags(F.col("t"), ["QUAY-77"]).items())).collect()
    kinds = [[k for k in r.asDict() if r[k]] for r in rows]
    assert kinds == [["postcode_value"], ["postcode_value"], ["company_number_value"], ["company_number_value"], ["company_name_value"], ["known_identifier_value"], [], [], []]


def test_staging(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    (source / "a.csv").write_text("group,rows\nx,3\ny,30\nz,0\n")
    (source / "b.txt").write_text("nothing here\n")
    found = disclosure.stage(spark, source, tmp_path / "out", {"a.csv": ("rows",), "b.txt": ()})
    assert found.passed and found.suppressed == (("a.csv", 1),) and (tmp_path / "out" / "a.csv").read_text() == "group,rows\ny,30\nz,0\n"
    with pytest.raises(ValueError):
        disclosure.stage(spark, source, tmp_path / "out", {"b.txt": ()})
    (source / "c.csv").write_text("Company Number,rows\n12345678,30\n")
    (source / "d.bin").write_bytes(b"x")
    with pytest.raises(disclosure.DisclosureError) as caught:
        disclosure.stage(spark, source, tmp_path / "two", {"c.csv": ("rows",)})
    assert {k for _, k in caught.value.report.findings} == {"identifier_column", "company_number_value"} and not (tmp_path / "two").exists()
    for name in ("../b.txt", "/b.txt", "working_files/b.txt", "d.bin"):
        with pytest.raises(ValueError):
            disclosure.stage(spark, source, tmp_path / "three", {name: ()})
    assert ("d.bin", "uninspectable_file") in disclosure.scan(spark, source)
    assert disclosure.known_identifiers(spark.createDataFrame([("Alpha Beta", "short", None)], "source_company_name string, source_trading_name string, matched_company_name string")) == ["Alpha Beta"]
    assert "E3_calibration.csv" in disclosure.allowed_files("locked") and "E3_split_counts.csv" not in disclosure.allowed_files("diagnostic")


def test_release_is_used_once(tmp_path):
    names = {n: tmp_path / n for n in ("judgments.csv", "companies-2026-05-20.zip", "code.py")}
    for p in names.values():
        p.write_text(p.name)
    now = dict(judgments=names["judgments.csv"], companies=names["companies-2026-05-20.zip"], observed=dt.date(2026, 6, 1), snapshot=dt.date(2026, 5, 20), settings={"a": 1}, package=tmp_path)
    manifest, key, approval = tmp_path / "m.json", tmp_path / "k", tmp_path / "a.json"
    release.write_manifest(manifest, release.build_manifest(**now))
    release.generate_key(key)
    release.approve(manifest, key, approval, "release-0001")
    granted = release.verify(manifest, approval, key)
    release.verify_sources(manifest, **now)
    receipt = release.reserve(tmp_path / "registry", granted)
    for again in (lambda: release.reserve(tmp_path / "registry", granted), lambda: release.generate_key(key), lambda: release.write_manifest(manifest, release.build_manifest(**now)), lambda: release.approve(manifest, key, approval, "release-0001")):
        with pytest.raises(release.ReleaseError):
            again()
    release.finalise(receipt, "completed", "run")
    assert json.loads(receipt.read_text())["status"] == "completed"
    with pytest.raises(release.ReleaseError):
        release.finalise(receipt, "failed")
    names["judgments.csv"].write_text("changed")
    with pytest.raises(release.ReleaseError, match="changed"):
        release.verify_sources(manifest, **now)
    other = tmp_path / "k2"
    release.generate_key(other)
    with pytest.raises(release.ReleaseError, match="signature"):
        release.verify(manifest, approval, other)
    broken = json.loads(manifest.read_text())
    broken["manifest"]["settings"] = {"a": 2}
    with pytest.raises(release.ReleaseError, match="changed"):
        release.checked_manifest(broken)
    for bad in (now | {"snapshot": dt.date(2026, 6, 2)}, now | {"snapshot": dt.date(2026, 4, 1)}, now | {"snapshot": dt.date(2026, 5, 21)}, now | {"bound": {"X": key}}, now | {"judgments": tmp_path / "none"}):
        with pytest.raises(release.ReleaseError):
            release.build_manifest(**bad)


def test_audit_and_population(spark):
    rows = [("J1", dt.date(2025, 1, 1), "Satisfied", "Corporate", "England and Wales", 700.0), ("J2", dt.date(2024, 1, 1), "Unsatisfied", "Corporate", "England and Wales", None), ("J3", dt.date(2026, 5, 30), "Cancelled", "Corporate", "England and Wales", 1.0), ("J4", None, "Satisfied", "Consumer", "Scotland", 1.0)]
    judgments = spark.createDataFrame(rows, "ID string, JudgmentDate date, JudgmentStatus string, DefendantType string, Jurisdiction string, Amount double")
    decisions = spark.createDataFrame([("J1", "exact_unique", "C1"), ("J2", "unmatched", ""), ("J3", "unmatched", ""), ("J4", "unmatched", "")], "ID string, tier string, matched_company_number string")
    counts = {(r["dimension"], r["value"]): r["rows"] for r in reports.audit_counts(judgments).collect()}
    assert counts["judgment_year", "missing"] == 1 and counts["amount_band", "500_999"] == 1 and counts["amount_band", "amount_missing"] == 1
    assert counts[reports.COMBINED, "Satisfied | Consumer | Scotland | missing"] == 1 and counts["input_column", "ID"] == 4
    found = {(r["analysis"], r["stratum"]): r for r in reports.population_comparison(judgments, decisions, dt.date(2026, 6, 1)).collect()}
    assert found["population", "all_corporate_england_wales_register_stock"]["rows"] == 3 and found["population", "excluded_unmatched_live_company_bulk"]["recorded_satisfied_rate"] == 0
    assert found["age_band", "over_12_to_24"]["unique_companies"] == 1 and found["linkage_selection", "match_tier_unmatched"]["negative"] == 1


def test_texts_and_log(tmp_path):
    assert [reports.count_text(x) for x in (None, 0, 9, 10, 12345, "x")] == ["n/a", "<10", "<10", "10", "12,345", "x"]
    assert [reports.hidden(x) for x in (0, 3, 10, 2.5, "x")] == [0, "<10", 10, 2.5, "x"]
    assert reports.percent_text(0.1234) == "12.3%" and reports.interval_text({"a": 0.5, "a_ci_low": 0.4, "a_ci_high": 0.6}, "a") == "0.500 (0.400 to 0.600)"
    log = reports.RunRecorder()
    with log.stage("read") as row:
        row["sample_rows"] = 5
    with pytest.raises(KeyError), log.stage("fail"):
        raise KeyError("x")
    assert log.write(tmp_path, {"company_stats": {"rows": 3, "analysis_fingerprint": 3}}) == ["E5_run_log.csv", "E5_run_manifest.json"]
    assert "<10" in (tmp_path / "E5_run_log.csv").read_text() and json.loads((tmp_path / "E5_run_manifest.json").read_text())["company_stats"] == {"analysis_fingerprint": 3, "rows": "<10"}
    text = reports.summary_text("locked", {"counts": {"rows_read": 5}, "models": {"m": {"roc_auc": 0.7}}, "acceptance": {"status": "fail", "reasons": ["r"]}})
    assert "rows read: <10" in text and "fail (r)" in text
