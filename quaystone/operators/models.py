"""Models of a binary label: imputing, scaling, logistic and boosted fits, calibration, choice and acceptance.

Fits are Spark ML's; imputing and scaling are expressions, since the library's imputer has an approximate median
and its scaler the sample deviation. Boosted trees are Spark's (``gbt``): they have no leaf limit and no
penalties, so they are named as what they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import clip_probability, logit
from . import metrics
from .checks import DataError, require_none, require_unique, same_ids
from .cohort import FAMILIES, SPLITS, Cohort, require_sound_splits

TREES = 500
#: Bins of each pass of an exact median.
MEDIAN_BINS = 1024


def exact_medians(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Medians that interpolate, by histograms that close in on the middle ranks: each pass reads the columns once and returns at most MEDIAN_BINS rows a column, however many values there are."""
    if not names:
        return {}
    value = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in names}
    facts = df.agg(*(f(value[c]).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    # A rank is looked for in [low, high]; ``below`` values lie under low.
    open_: dict[tuple[str, int], list[float]] = {}
    found: dict[tuple[str, int], float] = {}
    ranks: dict[str, tuple[int, int]] = {}
    for i, c in enumerate(names):
        if n := facts[f"n{i}"]:
            ranks[c] = ((n - 1) // 2, n // 2)
            for r in set(ranks[c]):
                open_[c, r] = [facts[f"a{i}"], facts[f"b{i}"], 0]
    while open_:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                found[key] = low
                del open_[key]
        if not open_:
            break
        parts = []
        for (c, r), (low, high, _) in open_.items():
            width = (high - low) / MEDIAN_BINS
            at = F.least(F.floor((value[c] - low) / width), F.lit(MEDIAN_BINS - 1)) if width > 0 else F.lit(0)
            parts.append(F.when((value[c] >= low) & (value[c] <= high), F.struct(F.lit(c).alias("c"), F.lit(r).cast("long").alias("r"), at.cast("int").alias("at"), value[c].alias("v"))))
        rows = df.select(F.explode(F.array(*parts)).alias("x")).where("x IS NOT NULL").groupBy("x.c", "x.r", "x.at").agg(F.count("*").alias("n"), F.min("x.v").alias("a"), F.max("x.v").alias("b")).collect()
        for (c, r), state in open_.items():
            below = state[2]
            for row in sorted((x for x in rows if (x["c"], x["r"]) == (c, r)), key=lambda x: x["at"]):
                if below + row["n"] > r:
                    state[:] = [row["a"], row["b"], below]
                    break
                below += row["n"]
    return {c: (found[c, ranks[c][0]] + found[c, ranks[c][1]]) / 2 if c in ranks else None for c in names}


@dataclass
class Preparation:
    """Medians and, where scaled, means and population deviations of the imputed features (1 for a constant one)."""

    names: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def columns(self) -> list[Column]:
        own = [F.when(F.isnan(F.col(f"`{c}`").cast("double")), None).otherwise(F.col(f"`{c}`").cast("double")) for c in self.names]
        filled = [F.coalesce(x, F.lit(self.medians[c])) for c, x in zip(self.names, own, strict=True)]
        return [(x - self.means[c]) / self.scales[c] for c, x in zip(self.names, filled, strict=True)] if self.scales else filled

    def features(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.array(*self.columns())))


def prepare(train: DataFrame, names: tuple[str, ...], scaled: bool) -> Preparation:
    """A feature without any value is kept as zeros."""
    medians = {c: m if m is not None else 0.0 for c, m in exact_medians(train, list(names)).items()}
    out = Preparation(tuple(names), medians)
    if scaled:
        filled = out.columns()
        facts = train.agg(*(f(x).alias(f"{k}{i}") for i, x in enumerate(filled) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        out.means = {c: facts[f"m{i}"] for i, c in enumerate(names)}
        out.scales = {c: facts[f"s{i}"] or 1.0 for i, c in enumerate(names)}
    return out


@dataclass
class Fitted:
    family: str
    algorithm: str
    preparation: Preparation
    model: Any
    trees: int | None = None

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Add the clipped probability; the cohort's own columns stay as they are."""
        own = [c for c in df.columns if c != name]
        scored = self.model.transform(self.preparation.features(df))
        return scored.select(*(F.col(f"`{c}`") for c in own), clip_probability(vector_to_array("probability")[1]).alias(name))

    def effects(self) -> list[dict[str, Any]]:
        """Coefficients on the scaled features, or the trees' importances: value, share of all, direction."""
        linear = self.algorithm == "logistic"
        values = [float(x) for x in (self.model.coefficients if linear else self.model.featureImportances).toArray()]
        total = sum(map(abs, values))
        direction = lambda x: ("positive" if x > 0 else "negative" if x < 0 else "zero") if linear else "not_directional"
        kind = "standardized_log_odds_coefficient" if linear else "gbt_importance"
        return [{"feature": c, "effect_type": kind, "value": x, "absolute_share": abs(x) / total if total else 0.0, "direction": direction(x)} for c, x in zip(self.preparation.names, values, strict=True)]

    def artefact(self) -> dict[str, Any]:
        """The model as plain values, for JSON; never a pickle."""
        p = self.preparation
        out: dict[str, Any] = {"schema_version": 1, "family": self.family, "algorithm": self.algorithm, "features": list(p.names), "imputer": {"strategy": "median", "statistics": [p.medians[c] for c in p.names]}, "best_iteration": self.trees}
        if p.scales:
            out["scaler"] = {"mean": [p.means[c] for c in p.names], "scale": [p.scales[c] for c in p.names]}
        if self.algorithm == "logistic":
            out["estimator"] = {"type": "spark_logistic_regression", "coefficient": [float(x) for x in self.model.coefficients], "intercept": float(self.model.intercept), "C": 1.0}
        else:
            out["estimator"] = {"type": "spark_gbt", "trees": self.model.toDebugString}
        return out


def _logistic(df: DataFrame, c: float, features: str = "features") -> Any:
    """An L2 fit with strength 1 / c on summed losses, the intercept free; features as they are."""
    n = df.count()
    return LogisticRegression(featuresCol=features, labelCol="label", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10).fit(df)


def fit_logistic(train: DataFrame, names: tuple[str, ...], family: str = "") -> Fitted:
    prepared = prepare(train, names, scaled=True)
    rows = prepared.features(train).select("features", F.col("label").cast("double").alias("label"))
    return Fitted(family, "logistic", prepared, _logistic(rows, 1.0))


def fit_boosted(train: DataFrame, names: tuple[str, ...], seed: int, family: str = "", validation: DataFrame | None = None, trees: int | None = None, most: int = TREES) -> Fitted:
    """Boosted trees; with a validation table they stop where its loss no longer falls, else ``trees`` are fitted."""
    prepared = prepare(train, names, scaled=False)
    rows = prepared.features(train).select("features", F.col("label").cast("double").alias("label"), F.lit(False).alias("held"))
    options = dict(maxIter=trees or most, stepSize=0.03, maxDepth=5, minInstancesPerNode=100, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, labelCol="label")
    if validation is not None and trees is None:
        rows = rows.union(prepared.features(validation).select("features", F.col("label").cast("double"), F.lit(True)))
        options |= {"validationIndicatorCol": "held", "validationTol": 1e-4}
    model = GBTClassifier(**options).fit(rows)
    return Fitted(family, "gbt", prepared, model, model.getNumTrees)


@dataclass
class Calibration:
    """A map of probabilities: isotonic, Platt's, or none where a class is too small."""

    method: str
    n_positive: int
    n_negative: int
    points: list[tuple[float, float]] = field(default_factory=list)
    slope: float = 1.0
    intercept: float = 0.0

    @property
    def powered(self) -> bool:
        return self.method != "underpowered"

    def apply(self, p: Column) -> Column:
        p = clip_probability(p)
        if self.method == "platt":
            return clip_probability(1 / (1 + F.exp(-(logit(p) * self.slope + self.intercept))))
        if self.method != "isotonic":
            return p
        # Linear between the two points around p.
        xs, ys = (F.array(*(F.lit(float(v)) for v in side)) for side in zip(*self.points, strict=True))
        at = F.size(F.filter(xs, lambda x: x <= p))
        x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
        inside = F.when(x1 > x0, y0 + (y1 - y0) * (p - x0) / (x1 - x0)).otherwise(y0)
        return clip_probability(F.when(at == 0, F.get(ys, F.lit(0))).when(at == len(self.points), y0).otherwise(inside))

    def as_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"method": self.method, "powered": self.powered, "n_positive": self.n_positive, "n_negative": self.n_negative}
        if self.method == "isotonic":
            out |= {"x_thresholds": [x for x, _ in self.points], "y_thresholds": [y for _, y in self.points]}
        elif self.method == "platt":
            out |= {"coefficient": self.slope, "intercept": self.intercept}
        return out


def fit_calibration(df: DataFrame, p: str = "p", y: str = "label", isotonic_from: int = 200, platt_from: int = 50) -> Calibration:
    """Isotonic where the smaller class has ``isotonic_from`` rows, Platt's from ``platt_from``, else none."""
    facts = df.agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")).first()
    positive, negative = facts["pos"], facts["neg"]
    rows = df.select(clip_probability(F.col(p)).alias("p"), F.col(y).cast("double").alias("label"))
    if min(positive, negative) >= isotonic_from:
        pooled = rows.groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
        model = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(pooled)
        points = list(zip((float(x) for x in model.boundaries), (float(x) for x in model.predictions), strict=True))
        return Calibration("isotonic", positive, negative, points)
    if min(positive, negative) >= platt_from:
        model = _logistic(rows.select(array_to_vector(F.array(logit(F.col("p")))).alias("features"), "label"), 1.0)
        return Calibration("platt", positive, negative, slope=float(model.coefficients[0]), intercept=float(model.intercept))
    return Calibration("underpowered", positive, negative)


def calibration_line(df: DataFrame, p: str = "p", y: str = "label") -> tuple[float | None, float | None]:
    """Intercept and slope of the label on the logit; nulls with one class."""
    rows = df.select(array_to_vector(F.array(logit(F.col(p)))).alias("features"), F.col(y).cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None, None
    model = _logistic(rows, 1e6)
    return float(model.intercept), float(model.coefficients[0])


def evaluate(df: DataFrame, p: str = "p", y: str = "label", key: str = "ID", training_prevalence: float | None = None) -> dict[str, Any]:
    """All metrics of predictions as plain values, capacities by fraction among them."""
    out = metrics.evaluate(df, p, y, training_prevalence).first().asDict()
    if not out["n"]:
        raise DataError("no prediction to evaluate")
    out["calibration_intercept"], out["calibration_slope"] = calibration_line(df, p, y)
    out["capacity_metrics"] = {metrics.fraction_name(r["fraction"]): r.asDict() for r in metrics.capacity(df, p, y, key).collect()}  # one row a fraction
    out["top_decile"] = out["capacity_metrics"]["10pct"]
    return out


def finite(x: Any) -> float | None:
    try:
        x = float(x)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def champion(logistic: dict[str, Any], boosted: dict[str, Any], name: str = "gbt") -> str:
    """The boosted model if its Brier score is 1 % lower at least and its AUC no lower; the logistic one in any other case."""
    values = [finite(m.get(k)) for k in ("brier", "roc_auc") for m in (logistic, boosted)]
    if any(v is None for v in values):
        return "logistic"
    return name if values[1] <= 0.99 * values[0] and values[3] >= values[2] else "logistic"


# The limits of acceptance.
LIMITS = {"min_test_rows": 1000, "min_test_each_class": 100, "auc_floor": 0.70, "max_calibration_gap": 0.03, "min_calibration_slope": 0.80, "max_calibration_slope": 1.20}


def acceptance(found: dict[str, Any], auc_lower: float | None, calibration: Calibration, family: str, limits: dict[str, float] = LIMITS) -> list[str]:
    """Reasons against a model; none if it passes. A value that is missing or impossible counts against it."""
    value = {k: finite(found.get(k)) for k in ("n", "n_positive", "n_negative", "roc_auc", "calibration_gap", "calibration_slope", "brier_improvement_vs_null")}
    counts = [value[k] for k in ("n", "n_positive", "n_negative")]
    whole = all(c is not None and c >= 0 and c == int(c) for c in counts)
    between = lambda x, lo, hi: x is not None and lo <= x <= hi
    rules = {
        "snapshot_exploratory_only": family in ("cross_sectional_primary", "prospective"),
        "test_rows_below_minimum": counts[0] is not None and counts[0] == int(counts[0]) and counts[0] >= limits["min_test_rows"],
        "test_class_count_below_minimum": whole and counts[1] + counts[2] == counts[0] and min(counts[1:]) >= limits["min_test_each_class"],
        "calibration_underpowered": calibration.powered,
        "auc_below_floor": between(value["roc_auc"], limits["auc_floor"], 1.0),
        "auc_lower_ci_not_above_chance": finite(auc_lower) is not None and 0.5 < finite(auc_lower) <= 1.0,
        "calibration_gap_above_maximum": between(value["calibration_gap"], 0.0, limits["max_calibration_gap"]),
        "calibration_slope_outside_range": between(value["calibration_slope"], limits["min_calibration_slope"], limits["max_calibration_slope"]),
        "brier_not_better_than_training_prevalence": value["brier_improvement_vs_null"] is not None and 0 < value["brier_improvement_vs_null"] <= 1,
    }
    return [reason for reason, holds in rules.items() if not holds]


@dataclass
class Development:
    cohort: Cohort
    validation: dict[str, dict[str, Any]]
    champions: dict[str, str]
    prevalence: float
    frozen: tuple[str, ...]
    specification: str
    models: dict[str, Fitted]
    calibrations: dict[str, Calibration]


def develop(cohort: Cohort, seed: int = 20260619, families: dict[str, tuple[str, ...]] = FAMILIES, trees: int = TREES, **powers: int) -> Development:
    """Fit every family on train, choose on validation, refit the age model and the primary champion on both, calibrate them. Test labels must be masked."""
    from .release import specification_hash

    data = cohort.frame
    require_sound_splits(data)
    parts = {s: data.where(F.col("split") == s) for s in SPLITS}
    sizes = {r["split"]: r for r in data.groupBy("split").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.min("label").alias("least"), F.max("label").alias("most")).collect()}
    if missing := [s for s in SPLITS if s not in sizes]:
        raise DataError(f"no rows in {', '.join(missing)}")
    if sizes["test"]["labelled"]:
        raise DataError("test labels must be masked before development")
    if unlabelled := [s for s in SPLITS[:-1] if sizes[s]["labelled"] < sizes[s]["n"]]:
        raise DataError(f"labels are missing in {', '.join(unlabelled)}")
    if sizes["train"]["least"] == sizes["train"]["most"]:
        raise DataError("the training rows have one class")
    fitted, scores, champions = {}, {}, {"age_only": "logistic"}
    for family, names in families.items():
        own = {"logistic": lambda n=names, f=family: fit_logistic(parts["train"], n, f)}
        if family != "age_only":
            own["gbt"] = lambda n=names, f=family: fit_boosted(parts["train"], n, seed, f, validation=parts["validation"], most=trees)
        for algorithm, fit in own.items():
            key = f"{family}.{algorithm}"
            fitted[key] = fit()
            scores[key] = evaluate(fitted[key].predict(parts["validation"]))
        if family != "age_only":
            champions[family] = champion(scores[f"{family}.logistic"], scores[f"{family}.gbt"])
    frozen = ("age_only.logistic", f"cross_sectional_primary.{champions['cross_sectional_primary']}")
    refit = data.where(F.col("split").isin("train", "validation"))
    prevalence = refit.agg(F.avg(F.col("label").cast("double"))).first()[0]
    models, calibrations = {}, {}
    for key in frozen:
        family, algorithm = key.split(".")
        models[key] = fit_logistic(refit, families[family], family) if algorithm == "logistic" else fit_boosted(refit, families[family], seed, family, trees=fitted[key].trees)
        calibrations[key] = fit_calibration(models[key].predict(parts["calibration"]), **powers)
    return Development(cohort, scores, champions, prevalence, frozen, specification_hash(cohort, frozen, champions, families, seed), models, calibrations)


def evaluate_locked(development: Development, outcomes: DataFrame, seed: int = 20260619, replicates: int = 1000, families: dict[str, tuple[str, ...]] = FAMILIES) -> dict[str, Any]:
    """Evaluate the frozen models on the released test labels (ID, label), once: prevalence baseline, age model, champion and its gain."""
    from .release import specification_hash

    cohort = development.cohort
    if specification_hash(cohort, development.frozen, development.champions, families, seed) != development.specification:
        raise DataError("the cohort no longer fits the frozen specification")
    test = cohort.frame.where(F.col("split") == "test")
    require_none(test, {"test labels came in before the release": F.col("label").isNotNull()}, "locked evaluation")
    require_unique(outcomes, "ID", "outcomes")
    if not same_ids(outcomes, test, "ID"):
        raise DataError("outcomes are not of exactly the test rows")
    require_none(outcomes, {"a label is neither 0 nor 1": ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))}, "outcomes")
    rows = test.drop("label").join(outcomes.select("ID", "label"), "ID")
    for i, key in enumerate(development.frozen):
        rows = development.models[key].predict(rows, f"raw{i}").withColumn(f"p{i}", development.calibrations[key].apply(F.col(f"raw{i}")))
    rows = rows.select("ID", "matched_company_number", "label", *(f"{k}{i}" for i in range(2) for k in ("raw", "p"))).withColumn("null", F.lit(development.prevalence))
    ci = lambda p: {r["metric"]: {"lower": r["lower"], "upper": r["upper"]} for r in metrics.bootstrap(rows, replicates, seed, p, "label", "matched_company_number", development.prevalence).collect()}
    out: dict[str, Any] = {"training_prevalence": development.prevalence, "champions": development.champions, "prevalence_baseline": {"metrics": evaluate(rows, "null", training_prevalence=development.prevalence), "bootstrap_intervals": ci("null")}, "runs": {}}
    for i, key in enumerate(development.frozen):
        family, algorithm = key.split(".")
        run = {"family": family, "algorithm": algorithm, "validation_metrics": development.validation[key], "test_metrics_raw": evaluate(rows, f"raw{i}", training_prevalence=development.prevalence), "test_metrics_calibrated": evaluate(rows, f"p{i}", training_prevalence=development.prevalence), "bootstrap_intervals": ci(f"p{i}")}
        run |= {"reliability_bins": [r.asDict() for r in metrics.reliability(rows, f"p{i}", "label", "ID").orderBy("bin").collect()], "feature_effects": development.models[key].effects(), "calibration": development.calibrations[key].as_dict(), "comparison_to_age_only": {}}
        if i:
            point = metrics.paired_deltas(metrics.evaluate(rows, "p1", "label").select("roc_auc", "average_precision", "brier", "log_loss"), metrics.evaluate(rows, "p0", "label").select("roc_auc", "average_precision", "brier", "log_loss"), [])
            paired = metrics.paired_bootstrap(rows, "p1", "p0", replicates, seed, "label", "matched_company_number")
            run["comparison_to_age_only"] = {"point_estimates": point.first().asDict(), "paired_company_clustered_intervals": {r["metric"]: {"lower": r["lower"], "upper": r["upper"]} for r in paired.collect()}}
        out["runs"][key] = run
    primary = out["runs"][development.frozen[-1]]
    reasons = acceptance(primary["test_metrics_calibrated"], primary["bootstrap_intervals"].get("roc_auc", {}).get("lower"), development.calibrations[development.frozen[-1]], primary["family"])
    out["primary_acceptance"] = {"status": "fail" if reasons else "pass", "passed": not reasons, "family": primary["family"], "algorithm": primary["algorithm"], "reasons": reasons, "guards": dict(LIMITS)}
    return out


def fit_evaluate(cohort: Cohort, outcomes: DataFrame | None, **options: Any) -> dict[str, Any]:
    """Development and locked evaluation in one call; without released outcomes it raises."""
    if outcomes is None:
        raise DataError("the test labels must be released and passed explicitly")
    return evaluate_locked(develop(cohort), outcomes, **options)


def write_artefacts(development: Development, evaluation: dict[str, Any], folder: str) -> list[str]:
    """The evaluation, each frozen model and a text summary as files of a folder; names of what was written."""
    from pathlib import Path

    from ..sources.files import write_json, write_text

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    splits = [r.asDict() for r in development.cohort.splits.collect()]
    write_json(out / "model_evaluation.json", evaluation | {"schema_version": 3, "splits": splits})
    written = ["model_evaluation.json"]
    for key in development.frozen:
        name = f"model_{key.replace('.', '_')}.json"
        role = "primary_champion" if key.startswith("cross_sectional_primary") else "age_only_baseline"
        write_json(out / name, development.models[key].artefact() | {"calibration": development.calibrations[key].as_dict(), "role": role})
        written.append(name)
    verdict = evaluation["primary_acceptance"]
    lines = [f"Locked evaluation, observed {development.cohort.observed.isoformat()}", f"Champion: {development.champions['cross_sectional_primary']}", f"Acceptance: {verdict['status']} ({', '.join(verdict['reasons']) or 'no reason against it'})", "Rows and companies by split:", *(f"  {s['split']}: {s['rows']}, {s['unique_companies']}" for s in splits), "No identifier and no single prediction is in these files."]
    write_text(out / "MODEL_SUMMARY.txt", "\n".join(lines) + "\n")
    return [*written, "MODEL_SUMMARY.txt"]

