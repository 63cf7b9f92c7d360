"""The register's reader: headings, codes, days, contradictions and the audit; and the company files."""

import datetime as dt
import zipfile

import pytest

from quaystone.operators.checks import DataError
from quaystone.sources import companies, files, register, synthetic

OBSERVED = dt.date(2024, 12, 31)
BASE = {"ID": "J-1", "Date Inserted": "05/02/2024", "JudgmentDate": "01/02/2024", "JudgmentStatus": "Unsatisfied", "DefendantType": "Corporate", "Jurisdiction": "England and Wales", "Defendant Company Name": "Alpha Ltd", "Defendant_Postcode": "AA1 1AA"}


def write(path, rows, encoding="utf-8"):
    import csv

    with open(path, "w", encoding=encoding, newline="") as file:
        out = csv.DictWriter(file, list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def test_reads_types_and_audits(spark, tmp_path):
    rows = [BASE | {"Amount": "£1,250.50", "Note": 'a, "b"'}, BASE | {"ID": "J-2", "JudgmentDate": "2024-03-01", "JudgmentStatus": " canceled ", "Jurisdiction": "England & Wales", "Amount": "bad", "Note": "x\ny", "Defendant Company Name": ""}]
    table, audit = register.read_register(spark, write(tmp_path / "a.csv", rows), "31/12/2024")
    found = {r["ID"]: r for r in table.collect()}
    assert found["J-1"]["Amount"] == 1250.5 and found["J-2"]["Amount"] is None and found["J-2"]["JudgmentStatus"] == "Cancelled"
    assert found["J-1"]["registration_lag_days"] == 4 and found["J-1"]["age_at_observation_days"] == 334
    assert audit["rows"] == 2 and audit["invalid_amount_rows"] == 1 and audit["missing_company_name_rows"] == 1
    assert audit["extra_headers"] == ["Note"] and audit["data_construct"] == "cross_sectional_status_only"
    assert audit["status_counts"] == {"Unsatisfied": 1, "Cancelled": 1} and audit["registration_lag_days_median"] == -10.5
    again, _ = register.read_register(spark, write(tmp_path / "b.csv", rows[::-1]), OBSERVED)
    assert _["analysis_fingerprint"] == audit["analysis_fingerprint"] != register.read_register(spark, write(tmp_path / "c.csv", rows[:1]), OBSERVED)[1]["analysis_fingerprint"]


def test_windows_encoding_and_workbook(spark, tmp_path):
    rows = [BASE | {"Amount": "£10", "Defendant Company Name": "Café Ltd"}]
    table, _ = register.read_register(spark, write(tmp_path / "w.csv", rows, "cp1252"), OBSERVED)
    assert table.first()["Defendant Company Name"] == "Café Ltd" and table.first()["Amount"] == 10
    files.write_xlsx(tmp_path / "w.xlsx", list(rows[0]), [list(r.values()) for r in rows])
    again, _ = register.read_register(spark, str(tmp_path / "w.xlsx"), OBSERVED)
    assert again.collect() == table.collect()
    with pytest.raises(DataError):
        register.read_register(spark, str(tmp_path / "w.parquet"), OBSERVED)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"ID": ""}, "blank"),
        ({"JudgmentStatus": "Paid"}, "unknown value"),
        ({"JudgmentDate": "32/01/2024"}, "no day"),
        ({"JudgmentDate": "01/01/2025"}, "after the observation"),
        ({"JudgmentStatus": "Satisfied", "Satisfaction Date": "31/01/2024"}, "before JudgmentDate"),
        ({"JudgmentStatus": "Satisfied", "Satisfaction Date": "01/01/2025"}, "after the observation"),
        ({"JudgmentStatus": "Satisfied", "Satisfaction Date": ""}, "Satisfied without"),
        ({"Satisfaction Date": "01/03/2024"}, "Unsatisfied with"),
        ({"JudgmentStatus": "Cancelled", "Cancellation Date": ""}, "Cancelled without"),
        ({"JudgmentStatus": "Satisfied", "Cancellation Date": "01/04/2024"}, "Cancellation Date on"),
        ({"Cancellation Reason": "set aside"}, "Cancellation Reason on"),
        ({"JudgmentStatus": "Satisfied", "Satisfaction Date": "01/03/2024", "Status Effective Date": "01/02/2024"}, "before its event"),
        ({"Snapshot Date": "30/12/2024"}, "not the observation"),
        ({"Payment plan": "x"}, "unknown column"),
        ({"Postcode": "x"}, "both stand for"),
    ],
)
def test_contradictions_raise(spark, tmp_path, change, message):
    with pytest.raises(DataError, match=message):
        register.read_register(spark, write(tmp_path / "x.csv", [BASE | change]), OBSERVED)


def test_repeated_ids_and_missing_columns_raise(spark, tmp_path):
    with pytest.raises(DataError, match="share an ID"):
        register.read_register(spark, write(tmp_path / "r.csv", [BASE, BASE]), OBSERVED)
    with pytest.raises(DataError, match="history"):
        register.read_register(spark, write(tmp_path / "s.csv", [BASE | {"Snapshot Date": "31/12/2024"}] * 2), OBSERVED)
    with pytest.raises(DataError, match="no column for"):
        register.read_register(spark, write(tmp_path / "m.csv", [{k: v for k, v in BASE.items() if k != "Jurisdiction"}]), OBSERVED)


def test_company_file(spark, tmp_path):
    rows = [{"Company Name": "NEW LTD", "CompanyNumber": " sc1 ", "RegAddress.PostCode": "AA1 1AA", "IncorporationDate": "01/02/2010", "CompanyStatus": "Active", "PreviousName_2.CompanyName": "OLD LTD", "PreviousName_2.CONDATE": "2012-01-01", "PreviousName_10.CompanyName": "", "Ignored": "x"}]
    path = write(tmp_path / "z.csv", rows)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.write(path, "b.csv")
        archive.writestr("c.csv", "nothing")
    plain, zipped = (companies.read_companies(spark, str(tmp_path / n)) for n in ("z.csv", "z.zip"))
    assert plain.collect() == zipped.collect()
    row = plain.first()
    assert row["company_number"] == "SC1" and row["incorporation_date"] == dt.date(2010, 2, 1) and row["CompanyStatus"] == "Active"
    assert [tuple(f) for f in row["former_names"]] == [("OLD LTD", dt.date(2012, 1, 1))]
    with pytest.raises(DataError):
        companies.standardised(plain, ["CompanyName"] * 3)


def test_settings_and_run_folders(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text("[cohort]\nprimary_max_months = 36\n[runtime]\nmin_cell_n = 5\n")
    assert files.load_settings(path).primary_max_months == 36
    for bad in ("[other]\nx = 1\n", "[cohort]\nx = 1\n", "[cohort]\nprimary_min_months = 50\n", "cohort = 1\n", "[acceptance]\nbootstrap_replicates = 9\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            files.load_settings(path)
    files.create_run(tmp_path, "locked", "t")
    with pytest.raises(FileExistsError):
        files.create_run(tmp_path, "locked", "t")
    files.write_json(tmp_path / "j.json", {"b": float("nan"), "a": (dt.date(2024, 1, 1),)})
    assert (tmp_path / "j.json").read_text() == '{\n  "a": [\n    "2024-01-01"\n  ],\n  "b": null\n}\n'


def test_synthetic_bundle_links_as_planted(spark, tmp_path):
    from quaystone.operators import linkage
    from pyspark.sql import functions as F

    paths = synthetic.write_bundle(synthetic.bundle(spark, 160), tmp_path)
    table, _ = register.read_register(spark, str(paths[0]), synthetic.OBSERVED)
    judgments = table.select("ID", "JudgmentDate", F.col("Defendant Company Name").alias("company_name"), F.col("Defendant Trading Name").alias("trading_name"), F.col("Defendant_Postcode").alias("postcode"))
    decided = linkage.match_checked(judgments, companies.read_companies(spark, str(paths[1])))
    truth = spark.read.csv(str(paths[2]), header=True)
    rows = truth.join(decided, "ID").collect()
    assert len(rows) == 160
    for r in rows:
        assert r["tier"] == synthetic.EXPECTED[r["corruption_class"]], r
        assert r["matched_company_number"] == (r["expected_company_number"] if r["tier"] == "exact_unique" else "")
    assert {r["matched_name_kind"] for r in rows if r["corruption_class"] == "former"} == {"former"}
