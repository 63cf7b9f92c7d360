"""Aggregate reports: audit marginals, population comparison, flat model tables, summaries and the run's log."""

from __future__ import annotations

import contextlib
import datetime as dt
import resource
import time
from collections.abc import Iterator
from copy import deepcopy
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import days_between, year_text
from ..functions.features import AGE_AUDIT_BANDS, AGE_BANDS, AMOUNT_BANDS, LAG_BANDS, MONTH, band, right_closed_band
from ..functions.text import composite_key
from .cohort import LABELS, age_window

LEAST_CELL = 10
COMBINED = "status_x_type_x_jurisdiction_x_vintage"
# Files of each report, and counts of the run log that the public form hides when small.
MATCH_FILES = {"tier_counts": "E2_match_coverage.csv", "unmatched_reasons": "E2_unmatched_reasons.csv", "method_counts": "E2_match_methods.csv", "by_defendant_type": "E2_match_by_defendant_type.csv", "by_judgment_vintage": "E2_match_by_judgment_vintage.csv", "guard_counts": "E2_incorporation_guards.csv"}
VALIDATION_FILES = {"estimates": "E2_linkage_validation_estimates.csv", "reviewer_agreement": "E2_linkage_reviewer_agreement.csv", "stratum_estimates": "E2_linkage_strata.csv"}
MODEL_TABLES = {"comparison": "E3_model_comparison.csv", "calibration": "E3_calibration.csv", "split_counts": "E3_split_counts.csv", "incremental": "E3_incremental_vs_age.csv", "ranking": "E3_operational_ranking.csv", "sensitivities": "E4_population_comparison.csv"}
LOG_COUNTS = ("ch_rows_read", "ch_rows_retained", "judgments_matched", "model_rows", "sample_rows", "suppressed_rows")


def marginals(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, rows, share) of every dimension, from one pass: each row gives one small row a dimension, summed before the shuffle."""
    cells = F.array(*(F.struct(F.lit(name).alias("dimension"), F.coalesce(v.cast("string"), F.lit("missing")).alias("value")) for name, v in dimensions.items()))
    counted = df.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("rows"))
    totals = counted.groupBy("dimension").agg(F.greatest(F.sum("rows"), F.lit(1)).alias("__all"))
    return counted.join(F.broadcast(totals), "dimension").select("dimension", "value", "rows", (F.col("rows") / F.col("__all")).alias("share"))


def audit_counts(judgments: DataFrame, audit: dict[str, Any] | None = None) -> DataFrame:
    """The data audit: marginals, the combined one, input columns and quality issues; unknown headings by number only."""
    year = year_text(F.col("JudgmentDate"))
    has = lambda c: F.col(c) if c in judgments.columns else F.lit(None).cast("double")
    four = composite_key(F.col("JudgmentStatus"), F.col("DefendantType"), F.col("Jurisdiction"), year, separator=" | ")
    dimensions = {
        "JudgmentStatus": F.col("JudgmentStatus"),
        "DefendantType": F.col("DefendantType"),
        "Jurisdiction": F.col("Jurisdiction"),
        "judgment_year": year,
        "amount_band": band(has("Amount"), *AMOUNT_BANDS, missing="amount_missing"),
        "registration_lag_band": band(has("registration_lag_days"), *LAG_BANDS),
        "observation_age_band": band(has("age_at_observation_months"), *AGE_AUDIT_BANDS),
        COMBINED: four,
    }
    rows = judgments.count()
    derived = ("registration_lag_", "age_at_", "judgment_year", "amount_band", "observation_age_band")
    facts = [("input_column", c, rows, 1.0) for c in judgments.columns if not c.startswith(derived)]
    if audit:
        facts.append(("data_construct", audit["data_construct"], rows, 1.0))
        facts += [("event_or_snapshot_column_present", c, rows, 1.0) for c in audit["event_date_columns_present"]]
        facts += [("extra_input_column_not_used", f"extra_column_{i + 1}", rows, 1.0) for i in range(len(audit["extra_headers"]))]
        facts += [("optional_column_absent_and_defaulted", c, rows, 1.0) for c in audit["absent_optional_columns"]]
        issues = {"invalid_amount": "invalid_amount_rows", "missing_company_name": "missing_company_name_rows", "missing_postcode": "missing_postcode_rows", "date_inserted_before_judgment": "date_inserted_before_judgment_rows", "date_inserted_after_observation_date": "date_inserted_after_observation_rows"}
        facts += [("data_quality_issue", k, audit[v], audit[v] / max(rows, 1)) for k, v in issues.items()]
    more = judgments.sparkSession.createDataFrame(facts, "dimension string, value string, rows long, share double")
    return marginals(judgments, dimensions).union(more).orderBy("dimension", "value")


def population_comparison(judgments: DataFrame, decisions: DataFrame, observed: dt.date, least_months: int = 1, most_months: int = 48) -> DataFrame:
    """Five nested populations, the tiers of the aged one, and its linked part by year, amount and age: rows, companies, labels, rate (null without a label).

    Every row is told once the strata it belongs to; one aggregate counts all of them.
    """
    amount = F.col("Amount").cast("double") if "Amount" in judgments.columns else F.lit(None).cast("double")
    joined = judgments.select("ID", "JudgmentDate", "JudgmentStatus", "DefendantType", "Jurisdiction", amount.alias("Amount")).join(decisions.select("ID", "tier", "matched_company_number"), "ID", "left")
    day, exact = F.col("JudgmentDate"), F.coalesce(F.col("tier") == "exact_unique", F.lit(False))
    described = F.coalesce((F.col("DefendantType") == "Corporate") & (F.col("Jurisdiction") == "England and Wales"), F.lit(False))
    base = described & F.coalesce(F.col("JudgmentStatus").isin(*LABELS), F.lit(False))
    aged = base & age_window(day, F.lit(observed), least_months, most_months)
    months = days_between(F.lit(observed), day) / F.lit(MONTH)
    of = lambda analysis, stratum, holds: F.when(holds, F.struct(F.lit(analysis).alias("analysis"), stratum.cast("string").alias("stratum")))
    strata = F.array(
        of("population", F.lit("all_corporate_england_wales_register_stock"), described),
        of("population", F.lit("binary_status_corporate_england_wales"), base),
        of("population", F.lit("post_one_to_48_month_binary_status"), aged),
        of("population", F.lit("included_unique_exact_live_company"), aged & exact),
        of("population", F.lit("excluded_unmatched_live_company_bulk"), aged & ~exact),
        of("linkage_selection", F.concat(F.lit("match_tier_"), F.coalesce("tier", F.lit("nan"))), aged),
        of("judgment_year", F.year(day), aged & exact),
        of("amount_band", band(F.col("Amount"), *AMOUNT_BANDS, missing="amount_missing"), aged & exact),
        of("age_band", right_closed_band(months, *AGE_BANDS), aged & exact),
    )
    company = F.nullif(F.col("matched_company_number"), F.lit(""))
    rows = joined.select(F.explode(F.filter(strata, lambda s: s.isNotNull())).alias("s"), company.alias("company"), "JudgmentStatus")
    count = lambda label: F.count_if(F.col("JudgmentStatus") == label)
    found = rows.groupBy("s.analysis", "s.stratum").agg(F.count("*").alias("rows"), F.count_distinct("company").alias("unique_companies"), count(LABELS[0]).alias("positive"), count(LABELS[1]).alias("negative"))
    return found.withColumn("recorded_satisfied_rate", F.try_divide(F.col("positive"), F.col("positive") + F.col("negative")))


def development_tables(spark: SparkSession, development: Any) -> dict[str, DataFrame]:
    """Validation metrics of each fitted model, and the splits; no test label is in them."""
    names = ("n", "n_positive", "n_negative", "roc_auc", "average_precision", "brier", "log_loss")
    rows = [(key, *key.split("."), key in development.frozen, *(m.get(n) for n in names)) for key, m in sorted(development.validation.items())]
    schema = "model string, family string, algorithm string, selected_for_locked_test boolean, validation_rows long, validation_positive long, validation_negative long, validation_roc_auc double, validation_average_precision double, validation_brier double, validation_log_loss double"
    return {"development": spark.createDataFrame(rows, schema), "split_counts": development.cohort.splits}


def evaluation_tables(spark: SparkSession, evaluation: dict[str, Any], splits: DataFrame) -> dict[str, DataFrame]:
    """A locked evaluation as flat tables: comparison, calibration bins, ranking and gain over the age model."""
    metrics = ("roc_auc", "average_precision", "brier", "log_loss", "calibration_gap", "calibration_intercept", "calibration_slope", "brier_improvement_vs_null", "log_loss_improvement_vs_null")
    comparison, bins, ranking, gain = [], [], [], []
    runs = {"prevalence_baseline": {"test_metrics_calibrated": evaluation["prevalence_baseline"]["metrics"], "bootstrap_intervals": evaluation["prevalence_baseline"]["bootstrap_intervals"], "reliability_bins": []}, **evaluation["runs"]}
    for key, run in sorted(runs.items()):
        m, ci = run["test_metrics_calibrated"], run["bootstrap_intervals"]
        for name in metrics:
            bounds = ci.get(name, {})
            comparison.append((key, m["n"], m["n_positive"], m["n_negative"], name, m.get(name), bounds.get("lower"), bounds.get("upper")))
        bins += [(key, b["bin"], b["rows"], b["positive"], b["negative"], b["mean_prediction"], b["observed_rate"]) for b in run["reliability_bins"]]
        for name, c in m["capacity_metrics"].items():
            lift = ci.get(f"capacity_{name}_lift", {})
            ranking.append((key, c["fraction"], c["selected"], c["selected_positive"], c["selected_negative"], c["positive_rate"], c["lift"], c["recall"], lift.get("lower"), lift.get("upper")))
        compared = run.get("comparison_to_age_only") or {}
        for name, bounds in compared.get("paired_company_clustered_intervals", {}).items():
            gain.append((key, name, compared["point_estimates"].get(name), bounds["lower"], bounds["upper"]))
    return {
        "comparison": spark.createDataFrame(comparison, "model string, test_rows long, test_positive long, test_negative long, metric string, value double, ci_low double, ci_high double"),
        "calibration": spark.createDataFrame(bins, "model string, bin long, rows long, positive long, negative long, mean_prediction double, observed_rate double"),
        "ranking": spark.createDataFrame(ranking, "model string, fraction double, selected long, selected_positive long, selected_negative long, positive_rate double, lift double, recall double, lift_ci_low double, lift_ci_high double"),
        "incremental": spark.createDataFrame(gain, "model string, measure string, estimate double, ci_low double, ci_high double"),
        "split_counts": splits,
    }


def write_tables(tables: dict[str, DataFrame], files: dict[str, str], folder: str | Path) -> list[str]:
    """The tables that have a file name, as CSV files of a folder."""
    from ..sources.files import write_csv

    written = []
    for key, name in files.items():
        if key in tables:
            write_csv(tables[key], Path(folder) / name)
            written.append(name)
    return written


def count_text(value: Any, least: int = LEAST_CELL) -> str:
    """A count with thousands marked; ``<least`` below the limit, zero included."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return "n/a" if value is None or value != value else str(value)
    return f"<{least}" if 0 <= n < least else f"{n:,}"


def number_text(value: Any, digits: int = 3, scale: float = 1.0, sign: str = "") -> str:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return "n/a" if value is None else str(value)
    return "n/a" if x != x else f"{scale * x:.{digits}f}{sign}"


def percent_text(value: Any) -> str:
    return number_text(value, 1, 100.0, "%")


def interval_text(metrics: dict[str, Any], name: str) -> str:
    value, low, high = (number_text(metrics.get(k)) for k in (name, f"{name}_ci_low", f"{name}_ci_high"))
    return value if "n/a" in (low, high) else f"{value} ({low} to {high})"


def hidden(value: Any, least: int = LEAST_CELL) -> Any:
    """A public count: ``<least`` for 1 to least - 1; zeros, larger counts and what is no whole number stay."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return value
    return f"<{least}" if x.is_integer() and 0 < x < least else value


def summary_text(stage: str, context: dict[str, Any], least: int = LEAST_CELL) -> str:
    """A summary for people: what a run read and linked and, past the first stage, how its models did. Small counts are masked."""
    counts, match, models = (context.get(k, {}) for k in ("counts", "match", "models"))
    lines = [f"Internal, not for release. Stage: {stage}", f"Observed {context.get('observation_date', 'unknown')}, companies of {context.get('company_snapshot_date', 'unknown')}", f"Data: {context.get('data_construct', 'unknown')}", ""]
    for name in ("rows_read", "matching_decisions", "missing_company_name", "missing_postcode", "date_inserted_before_judgment"):
        lines.append(f"{name.replace('_', ' ')}: {count_text(counts.get(name), least)}")
    lines += ["", *(f"{name.replace('_', ' ')}: {count_text(match.get(name), least)}" for name in ("denominator", "exact_unique", "unmatched")), f"coverage: {percent_text(match.get('coverage'))}"]
    if stage != "diagnostic":
        lines += ["", *(f"{split}: {count_text(n, least)} rows" for split, n in context.get("splits", {}).items())]
        for key, m in sorted(models.items()):
            lines.append(f"{key}: AUC {interval_text(m, 'roc_auc')}, Brier {interval_text(m, 'brier')}, gap {number_text(m.get('calibration_gap'))}, slope {number_text(m.get('calibration_slope'), 2)}")
    if stage == "locked":
        verdict = context.get("acceptance", {})
        lines.append(f"acceptance: {verdict.get('status', 'unknown')} ({', '.join(verdict.get('reasons', [])) or 'no reason against it'})")
    return "\n".join([*lines, "", *LIMITATIONS]) + "\n"


LIMITATIONS = (
    "The outcome is the status recorded on the extract's day, not money recovered and not a later status.",
    "Only one unique, date-valid, equal name links a judgment; postcodes are told and never decide.",
    "The company file holds live companies of one day; dissolved ones stay unmatched.",
    "Judgments of one company stay in one split and are drawn together.",
)


def public_log(stages: list[dict[str, Any]], least: int = LEAST_CELL) -> list[dict[str, Any]]:
    return [{k: hidden(v, least) if k in LOG_COUNTS else v for k, v in row.items()} for row in stages]


def public_manifest(manifest: dict[str, Any], least: int = LEAST_CELL) -> dict[str, Any]:
    """A run's manifest without small counts, test counts and the training prevalence."""
    out = deepcopy(manifest)
    stats = out.get("company_stats")
    if isinstance(stats, dict):
        out["company_stats"] = {k: v if k == "analysis_fingerprint" else hidden(v, least) for k, v in stats.items()}
    verdict = out.get("acceptance")
    if isinstance(verdict, dict):
        verdict.pop("cohort_test_counts", None)
        if isinstance(verdict.get("guards"), dict):
            verdict["guards"].pop("training_prevalence", None)
    for row in (out.get("disclosure") or {}).get("suppressed_rows", []):
        if "rows" in row:
            row["rows"] = hidden(row["rows"], least)
    return out


class RunRecorder:
    """Times, memory and facts of a run's stages."""

    def __init__(self) -> None:
        self.stages: list[dict[str, Any]] = []
        self.warnings: list[str] = []

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[dict[str, Any]]:
        row: dict[str, Any] = {"stage": name, "started_utc": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")}
        began = time.perf_counter()
        try:
            yield row
            row["status"] = "ok"
        except Exception as fault:
            row |= {"status": "failed", "error": f"{type(fault).__name__}: {fault}"}
            raise
        finally:
            row |= {"elapsed_seconds": round(time.perf_counter() - began, 3), "peak_memory_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)}
            self.stages.append(row)

    def warn(self, text: str) -> None:
        self.warnings.append(text)

    def write(self, folder: str | Path, manifest: dict[str, Any], least: int = LEAST_CELL) -> list[str]:
        """The public log and manifest as files."""
        import csv

        from ..sources.files import write_json

        names = list(dict.fromkeys(k for row in self.stages for k in row))
        with open(Path(folder) / "E5_run_log.csv", "w", encoding="utf-8", newline="") as file:
            out = csv.DictWriter(file, names, lineterminator="\n")
            out.writeheader()
            out.writerows(public_log(self.stages, least))
        write_json(Path(folder) / "E5_run_manifest.json", public_manifest(manifest, least) | {"warnings": self.warnings})
        return ["E5_run_log.csv", "E5_run_manifest.json"]
