"""Adjudications, estimates and metrics against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quaystone.operators import adjudication, metrics
from quaystone.operators.checks import DataError

FIELDS = ["ID", "validation_arm", "sampling_stratum", "stratum_population_n", "stratum_sample_n", "inclusion_probability", "sampling_weight", "matched_company_number", "reviewer_1_label", "reviewer_1_company_number", "reviewer_2_label", "reviewer_2_company_number", "adjudicated_label", "adjudicated_company_number", "adjudication_notes"]


def reviewed():
    rows = [dict(zip(FIELDS, (f"A-{i}", "accepted", "tier=exact_unique", 100, 4, 0.04, 25.0, f"A{i}", x, "", x, "", x, "", ""))) for i, x in enumerate(["correct_match"] * 3 + ["incorrect_match"])]
    k = 0
    for stratum, n in (("reason=one|judgment_year=2022", 1), ("reason=two|judgment_year=2023", 2)):
        for i in range(4):
            label, company = ("missed_match", f"M{k}") if i < n else ("true_unmatched", "")
            second = ("true_unmatched", "") if k == 0 else (label, company)
            rows.append(dict(zip(FIELDS, (f"U-{k}", "unmatched", stratum, 50, 4, 0.08, 12.5, "", label, company, *second, label, company, ""))))
            k += 1
    return rows


def table(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], "ID string, validation_arm string, sampling_stratum string, stratum_population_n long, stratum_sample_n long, inclusion_probability double, sampling_weight double, matched_company_number string, reviewer_1_label string, reviewer_1_company_number string, reviewer_2_label string, reviewer_2_company_number string, adjudicated_label string, adjudicated_company_number string, adjudication_notes string")


def test_weighted_accuracy_and_gated_recall(spark):
    held = {r["measure"]: r for r in adjudication.summary(table(spark, reviewed()))["estimates"].collect()}
    assert held["accepted_match_precision"]["estimate"] == 0.75 and held["unmatched_missed_link_prevalence"]["estimate"] == 0.375
    assert held["linkage_recall"]["status"] == "not_estimated" and held["linkage_recall"]["estimate"] is None
    z = 1.959963984540054
    centre, radius = (0.75 + z * z / 8) / (1 + z * z / 4), z * math.sqrt(0.75 * 0.25 / 4 + z * z / 64) / (1 + z * z / 4)
    assert held["accepted_match_precision"]["lower_ci"] == pytest.approx(centre - radius) and held["accepted_match_precision"]["upper_ci"] == pytest.approx(min(1, centre + radius))
    found = adjudication.summary(table(spark, reviewed()), recall_supported=True)
    recall = {r["measure"]: r for r in found["estimates"].collect()}["linkage_recall"]
    assert recall["estimate"] == pytest.approx(2 / 3) and 0 <= recall["lower_ci"] <= 2 / 3 <= recall["upper_ci"] <= 1
    agreement = {r["validation_arm"]: r for r in found["reviewer_agreement"].collect()}
    assert agreement["overall"]["label_agreement"] == agreement["overall"]["decision_agreement"] == pytest.approx(11 / 12) and agreement["accepted"]["cohen_kappa"] == 1
    assert {r["sampling_stratum"]: r["weighted_positive_total"] for r in found["stratum_estimates"].collect()} == {"tier=exact_unique": 75, "reason=one|judgment_year=2022": 12.5, "reason=two|judgment_year=2023": 25}


def test_census_is_exact(spark):
    rows = [r | {"stratum_population_n": 4, "inclusion_probability": 1.0, "sampling_weight": 1.0} for r in reviewed()]
    found = {r["measure"]: r for r in adjudication.summary(table(spark, rows))["estimates"].collect()}
    assert found["accepted_match_precision"]["lower_ci"] == found["accepted_match_precision"]["upper_ci"] == 0.75


CASES = [
    (0, "reviewer_1_label", "", "blank"),
    (0, "reviewer_1_label", "missed_match", "not of its arm"),
    (0, "adjudicated_label", "incorrect_match", "differs from agreeing"),
    (0, "matched_company_number", "", "no matched company"),
    (0, "reviewer_2_company_number", "x9", "not the match"),
    (4, "reviewer_1_company_number", " ", "is missing"),
    (5, "reviewer_2_company_number", "x9", "must be blank"),
    (8, "adjudicated_company_number", "x9", "adjudicated_company_number differs"),
    (0, "stratum_population_n", 99, "not one number"),
    (0, "validation_arm", "third", "unknown arm"),
    (0, "ID", "U-1", "share a value"),
]


@pytest.mark.parametrize(("row", "field", "value", "message"), CASES)
def test_broken_reviews_raise(spark, row, field, value, message):
    rows = reviewed()
    rows[row][field] = value
    with pytest.raises(DataError, match=message):
        adjudication.validated(table(spark, rows))


def test_membership_must_not_change(spark):
    expected = table(spark, reviewed())
    adjudication.require_membership(expected.drop("adjudication_notes"), adjudication.cleaned(expected))
    with pytest.raises(DataError, match="membership"):
        adjudication.require_membership(expected, expected.where("ID <> 'A-0'"))
    with pytest.raises(DataError, match="sampling_weight"):
        adjudication.require_membership(expected, expected.withColumn("sampling_weight", F.col("sampling_weight") * 1.1))
    with pytest.raises(DataError, match="outcome|hold"):
        adjudication.validated(expected.withColumn("Outcome", F.lit(1)))


RNG = random.Random(3)
ROWS = [(i, RNG.randrange(30), round(RNG.random(), 2), int(RNG.random() < 0.35)) for i in range(500)]


def plain(rows, fractions=metrics.FRACTIONS):
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    pos, neg = [clip(p) for _, _, p, y in rows if y], [clip(p) for _, _, p, y in rows if not y]
    n = len(rows)
    out = {"roc_auc": sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)}
    out["average_precision"] = sum(sum(x >= t for x in pos) / (sum(x >= t for x in pos) + sum(x >= t for x in neg)) for t in pos) / len(pos)
    out["brier"] = sum((clip(p) - y) ** 2 for _, _, p, y in rows) / n
    out["log_loss"] = -sum(math.log(clip(p) if y else 1 - clip(p)) for _, _, p, y in rows) / n
    out["calibration_gap"] = abs(sum(clip(p) for _, _, p, _ in rows) / n - len(pos) / n)
    return out


def test_metrics_equal_plain_ones(spark):
    df = spark.createDataFrame(ROWS, "id long, cluster long, p double, y int")
    found = metrics.evaluate(df, training_prevalence=0.3).first()
    for name, value in plain(ROWS).items():
        assert found[name] == pytest.approx(value, abs=1e-9), name
    base = sum(r[3] for r in ROWS) / 500
    assert found["brier_improvement_vs_null"] == pytest.approx(base * 0.49 + (1 - base) * 0.09 - found["brier"])
    one = metrics.evaluate(df.where("y = 0")).first()
    assert one["roc_auc"] is None and one["average_precision"] is None
    order = sorted(ROWS, key=lambda r: (-r[2], r[0]))
    for r in metrics.capacity(df).collect():
        k = max(1, math.ceil(500 * r["fraction"]))
        hits = sum(x[3] for x in order[:k])
        assert (r["selected"], r["selected_positive"]) == (k, hits) and r["lift"] == pytest.approx(hits / k / base)
    bins = metrics.reliability(df.where("id < 498"), bins=10).orderBy("bin").collect()
    order = sorted(ROWS[:498], key=lambda r: (r[2], r[0]))
    sizes = [50] * 8 + [49] * 2
    assert [b["rows"] for b in bins] == sizes
    at = 0
    for b, size in zip(bins, sizes, strict=True):
        own = order[at : at + size]
        assert b["positive"] == sum(r[3] for r in own) and b["mean_prediction"] == pytest.approx(sum(max(r[2], 1e-6) for r in own) / size)
        at += size


def test_bootstrap_equals_replicates_drawn_one_by_one(spark):
    df = spark.createDataFrame([(*r, min(1.0, r[2] + 0.1)) for r in ROWS], "id long, cluster long, p double, y int, q double")
    weights = {}
    for r in metrics.draws(df, "cluster", 5, 9).collect():
        weights.setdefault(r["replicate"], {})[r["cluster"]] = r["weight"]
    assert all(sum(w.values()) == len({r[1] for r in ROWS}) for w in weights.values()) and len(weights) == 5
    table_ = metrics.replicated(df.select("cluster", "p", "y"), metrics.draws(df, "cluster", 5, 9), "cluster", ["p"])
    for r in metrics.replicate_metrics(table_.withColumn("p", F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)))).collect():
        rows = [x for x in ROWS for _ in range(weights[r["replicate"]].get(x[1], 0))]
        for name, value in plain(rows).items():
            assert r[name] == pytest.approx(value, abs=1e-9), name
    found = {r["metric"]: r for r in metrics.bootstrap(df, 40, 9, training_prevalence=0.3).collect()}
    assert found["roc_auc"]["lower"] < plain(ROWS)["roc_auc"] < found["roc_auc"]["upper"] and "capacity_10pct_lift" in found
    paired = {r["metric"]: r for r in metrics.paired_bootstrap(df, "p", "q", 20, 9).collect()}
    assert paired["brier_improvement_vs_age_only"]["lower"] <= paired["brier_improvement_vs_age_only"]["upper"]
    assert metrics.bootstrap(df.where("cluster = 1"), 5, 9).isEmpty()
    classes = metrics.stratified_draws(df, 3, 9).join(df, "id").groupBy("replicate", "y").agg(F.sum("weight").alias("n"))
    assert {(r["y"], r["n"]) for r in classes.collect()} == {(y, sum(r[3] == y for r in ROWS)) for y in (0, 1)}
