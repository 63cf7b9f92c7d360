"""The cohort's edges, history and splits; fits, calibration, choice, acceptance, development and locked evaluation."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quaystone.operators import cohort, models, release
from quaystone.operators.checks import DataError

OBSERVED = dt.date(2026, 6, 1)


def test_prior_history(spark):
    day = dt.date.fromisoformat
    rows = [("C2", day("2025-06-15"), 999.0, 0), ("C1", day("2024-12-01"), None, 1), ("C1", day("2022-12-31"), 50.0, 2), ("C2", day("2023-06-15"), 20.0, 3), ("C1", day("2023-01-01"), 10.0, 4), ("C2", day("2024-06-15"), 30.0, 5), ("C1", day("2025-01-01"), 1.0, 6), ("C2", day("2025-06-15"), 7.0, 7), ("C3", day("2020-01-01"), 1.0, 8), ("C3", day("2025-01-01"), 1.0, 9)]
    table = spark.createDataFrame(rows, "c string, d date, a double, k int")
    found = {r["k"]: tuple(r[n] for n in cohort.HISTORY_FEATURES[:4]) for r in cohort.with_prior_history(table, "c", "d", "a").collect()}
    assert found[0] == found[7] == (2, 50.0, 365.0, 0)
    assert found[6] == (2, 10.0, 31.0, 0)
    assert found[9] == found[8] == (0, 0.0, None, 1)


def test_split_sizes_and_digest_order(spark):
    ages = {f"C{i:03d}": (i % 4) * 12 + 6 for i in range(203)}
    table = spark.createDataFrame([(f"J{c}{k}", c, float(a + k)) for c, a in ages.items() for k in range(1 + a % 2)], "ID string, matched_company_number string, observation_age_months double")
    found = {r[0]: r[1] for r in cohort.company_splits(table).collect()}
    for stratum in range(4):
        own = sorted((c for c, a in ages.items() if (a - 6) // 12 == stratum), key=lambda c: hashlib.sha256(f"20260619\0{c}".encode()).hexdigest())
        raw = [0.6 * len(own), 0.15 * len(own), 0.1 * len(own), 0.15 * len(own)]
        sizes = [math.floor(x) for x in raw]
        for i in sorted(range(4), key=lambda i: -(raw[i] - sizes[i]))[: len(own) - sum(sizes)]:
            sizes[i] += 1
        want = [s for s, n in zip(cohort.SPLITS, sizes, strict=True) for _ in range(n)]
        assert [found[c] for c in own] == want
    split = cohort.with_company_splits(table)
    cohort.require_sound_splits(split)
    assert {r["split"] for r in cohort.split_counts(split).collect()} == set(cohort.SPLITS)
    with pytest.raises(DataError):
        cohort.require_sound_splits(split.union(split.withColumn("split", F.lit("test"))))


@pytest.mark.parametrize(("sizes", "want"), [([1] * 20, [12, 3, 2, 3]), ([5, 4, 3, 2, 2], None), ([2, 1], None)])
def test_chronological_split(spark, sizes, want):
    days = [dt.date(2020, 1, 1) + dt.timedelta(d) for d, n in enumerate(sizes) for _ in range(n)]
    table = spark.createDataFrame([(f"C{i}", d) for i, d in enumerate(days)], "matched_company_number string, JudgmentDate date")
    found = cohort.with_chronological_splits(table).orderBy("JudgmentDate").collect()
    order = [cohort.SPLITS.index(r["split"]) for r in found]
    assert order == sorted(order) and len({(r["JudgmentDate"], r["split"]) for r in found}) == len(sizes)
    if want:
        assert [order.count(i) for i in range(4)] == want


def inputs(spark, companies=450, seed=1):
    rng = random.Random(seed)
    js, ds = [], []
    for i in range(companies):
        for k in range(2 if i % 7 == 0 else 1):
            age = rng.randrange(40, 1400)
            y = rng.random() < 1 / (1 + math.exp(-(age - 700) / 200))
            js.append((f"J{i}-{k}", OBSERVED - dt.timedelta(age), "Satisfied" if y else "Unsatisfied", "Corporate", "England and Wales", rng.choice([None, 100.0 * rng.random(), -5.0])))
            ds.append((f"J{i}-{k}", f"C{i:04d}", "exact_unique", dt.date(2010, 1, 1) + dt.timedelta(i), str(i % 4), str(i % 3), "01/01/2026", "Active" if i % 2 else "Liquidation"))
    judgments = spark.createDataFrame(js, "ID string, JudgmentDate date, JudgmentStatus string, DefendantType string, Jurisdiction string, Amount double")
    decisions = spark.createDataFrame(ds, ["ID", "matched_company_number", "tier", "IncorporationDate", "Mortgages.NumMortCharges", "Mortgages.NumMortSatisfied", "Accounts.NextDueDate", "CompanyStatus"])
    return judgments, decisions


def test_age_window_edges_and_funnel(spark):
    days = {"one": dt.date(2026, 5, 1), "post-one": dt.date(2026, 4, 30), "forty-eight": dt.date(2022, 6, 1), "too-old": dt.date(2022, 5, 31)}
    judgments = spark.createDataFrame([(i, d, "Satisfied", " corporate", "ENGLAND AND WALES", 1.0) for i, d in days.items()], "ID string, JudgmentDate date, JudgmentStatus string, DefendantType string, Jurisdiction string, Amount double")
    decisions = spark.createDataFrame([(i, f"C{i}", "exact_unique", "2010-01-01") for i in days], "ID string, matched_company_number string, tier string, incorporation_date string")
    made = cohort.prepare(judgments, decisions, OBSERVED)
    assert {r["ID"] for r in made.frame.collect()} == {"post-one", "forty-eight"}
    assert made.funnel["judgments_read"] == 4 and made.funnel["eligible_judgments"] == 2 and made.funnel["eligible_repeat_judgments"] == 0
    for bad, message in ((decisions.withColumn("tier", F.lit("fuzzy")), "unknown"), (decisions.withColumn("matched_company_number", F.lit(" ")), "no company number"), (decisions.withColumn("incorporation_date", F.lit("")), "no incorporation"), (decisions.withColumnRenamed("tier", "match_tier"), "former column"), (decisions.union(decisions), "share a value")):
        with pytest.raises(DataError, match=message):
            cohort.prepare(judgments, bad, OBSERVED)


@pytest.fixture(scope="module")
def made(spark):
    return cohort.prepare(*inputs(spark), OBSERVED)


def test_cohort_masks_and_carries_features(spark, made):
    rows = made.frame.collect()
    assert all((r["label"] is None) == (r["split"] == "test") for r in rows)
    assert all(r["snapshot_n_charges"] is not None and 0 <= r["observable_retained_history_calendar_coverage_24m"] <= 1 for r in rows)
    assert all(r["log1p_judgment_amount"] >= 0 for r in rows) and made.funnel["eligible_judgments"] == len(rows)


def test_median_and_preparation(spark):
    table = spark.createDataFrame([(float(i * i % 97), None, float("nan") if i % 5 else 2.0, 3.0) for i in range(100)], "a double, b double, c double, d double")
    values = sorted(i * i % 97 for i in range(100))
    assert models.exact_medians(table, ["a", "b", "c", "d"]) == {"a": (values[49] + values[50]) / 2, "b": None, "c": 2.0, "d": 3.0}
    got = models.prepare(table, ("a", "b", "d"), scaled=True)
    mean = sum(values) / 100
    assert got.means["a"] == pytest.approx(mean) and got.scales["a"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / 100)) and got.scales["d"] == 1.0 and got.medians["b"] == 0


def test_logistic_is_at_its_optimum(spark):
    rng = random.Random(5)
    rows = [(x := rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-x)))) for _ in range(300)]
    fitted = models.fit_logistic(spark.createDataFrame(rows, "x double, label int"), ("x",))
    mean, w, b = fitted.preparation.means["x"], fitted.model.coefficients[0], fitted.model.intercept
    z = [((x - mean) / fitted.preparation.scales["x"], y) for x, y in rows]
    p = [1 / (1 + math.exp(-(w * x + b))) for x, _ in z]
    assert sum(q - y for q, (_, y) in zip(p, z)) == pytest.approx(0, abs=1e-3)
    assert sum((q - y) * x for q, (x, y) in zip(p, z)) + w == pytest.approx(0, abs=1e-3)  # the penalty's part is w / C


def test_calibration_powers(spark):
    for each, method in ((200, "isotonic"), (50, "platt"), (49, "underpowered")):
        rows = spark.createDataFrame([(0.01 + 0.98 * i / (2 * each - 1), int(i >= each)) for i in range(2 * each)], "p double, label int")
        found = models.fit_calibration(rows)
        assert found.method == method and found.powered == (method != "underpowered")
        values = [r[0] for r in rows.select(found.apply(F.col("p")).alias("q")).orderBy("p").collect()]
        assert values == sorted(values) and 0 < values[0] and values[-1] < 1
    assert values[:1] == [pytest.approx(0.01)]
    steps = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)] * 200, "p double, label int")
    found = models.fit_calibration(steps)
    assert [r[0] for r in steps.select(found.apply(F.col("p"))).limit(4).collect()] == pytest.approx([1e-6, 0.5, 0.5, 1 - 1e-6])


def test_champion_and_acceptance():
    base = {"brier": 0.10, "roc_auc": 0.70}
    assert [models.champion(base, {"brier": b, "roc_auc": a}) for b, a in ((0.09, 0.71), (0.0995, 0.71), (0.09, 0.69), (0.11, 0.75), (float("nan"), 0.8))] == ["gbt", "logistic", "logistic", "logistic", "logistic"]
    good = {"n": 2000, "n_positive": 900, "n_negative": 1100, "roc_auc": 0.8, "calibration_gap": 0.01, "calibration_slope": 1.0, "brier_improvement_vs_null": 0.02}
    powered = models.Calibration("platt", 100, 100)
    assert models.acceptance(good, 0.75, powered, "cross_sectional_primary") == []
    bad = dict.fromkeys(good, None)
    assert len(models.acceptance(bad, None, models.Calibration("underpowered", 1, 1), "snapshot_exploratory")) == 9
    assert models.acceptance(good | {"n_positive": 901}, 0.75, powered, "cross_sectional_primary") == ["test_class_count_below_minimum"]


def test_development_and_locked_evaluation(spark, made, tmp_path):
    judgments, _ = inputs(spark)
    families = {k: v for k, v in cohort.FAMILIES.items() if k != "snapshot_exploratory"}
    made.frame = made.frame.checkpoint()
    developed = models.develop(made, families=families, trees=2, isotonic_from=15, platt_from=5)
    outcomes = cohort.locked_labels(judgments, made).checkpoint()
    found = models.evaluate_locked(developed, outcomes, replicates=5, families=families)
    primary = found["runs"][developed.frozen[-1]]
    assert primary["test_metrics_calibrated"]["roc_auc"] > 0.6 and primary["bootstrap_intervals"]["roc_auc"]["lower"] < primary["test_metrics_calibrated"]["roc_auc"]
    assert "test_rows_below_minimum" in found["primary_acceptance"]["reasons"]
    assert sum(e["absolute_share"] for e in primary["feature_effects"]) == pytest.approx(1)
    assert sorted(models.write_artefacts(developed, found, str(tmp_path))) == sorted(p.name for p in tmp_path.iterdir())
    from quaystone.operators import reports

    tables = reports.evaluation_tables(spark, found, made.splits)
    assert {r["model"] for r in tables["comparison"].collect()} == {"prevalence_baseline", *developed.frozen} and tables["calibration"].count() == 20
    with pytest.raises(DataError):
        models.evaluate_locked(developed, outcomes.limit(3), replicates=5, families=families)
    developed.champions = {**developed.champions, "x": "y"}
    with pytest.raises(DataError, match="specification"):
        models.evaluate_locked(developed, outcomes, replicates=5, families=families)
    with pytest.raises(DataError):
        models.fit_evaluate(made, None)


def test_fingerprint_tells_content_apart(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    prints = [release.content_fingerprint(t).first()["fingerprint"] for t in (a, a.orderBy("k", ascending=False).repartition(3), a.limit(2), a.withColumnRenamed("v", "w"), a.na.fill(""), a.select("v", "k"))]
    assert prints[0] == prints[1] and len(set(prints)) == 5
