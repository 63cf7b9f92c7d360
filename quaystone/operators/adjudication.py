"""Review of audit samples: what breaks the rules, and design-weighted estimates of linkage accuracy."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_company_number, clean_label
from .checks import DataError, require_columns, require_unique
from .sampling import REVIEW_COLUMNS, require_no_outcomes

# The labels of each arm, the positive one first.
ARM_LABELS = {"accepted": ("correct_match", "incorrect_match"), "unmatched": ("missed_match", "true_unmatched")}
ROLES = ("reviewer_1", "reviewer_2", "adjudicated")
DESIGN = ("ID", "validation_arm", "sampling_stratum", "stratum_population_n", "stratum_sample_n", "inclusion_probability", "sampling_weight")


def cleaned(df: DataFrame) -> DataFrame:
    """Labels in lower case, company numbers without blanks in upper case, absent number columns empty."""
    numbers = ["matched_company_number", *(f"{r}_company_number" for r in ROLES)]
    out = df.withColumns({c: clean_label(F.col(c)) for c in ("validation_arm", *(f"{r}_label" for r in ROLES))})
    return out.withColumns({c: clean_company_number(F.col(c)) if c in df.columns else F.lit("") for c in numbers})


def violation(df: DataFrame, name: str = "violation") -> DataFrame:
    """Add the first rule that a cleaned row breaks, null for a sound one."""
    arm, label, number = F.col("validation_arm"), lambda r: F.col(f"{r}_label"), lambda r: F.col(f"{r}_company_number")
    allowed = lambda r: F.when(arm == "accepted", label(r).isin(*ARM_LABELS["accepted"])).otherwise(label(r).isin(*ARM_LABELS["unmatched"]))
    first, second, final = ROLES
    rule = F.when(~arm.isin(*ARM_LABELS), "unknown arm")
    for r in ROLES:
        rule = rule.when(label(r) == "", f"{r}_label is blank").when(~allowed(r), f"{r}_label is not of its arm")
    rule = rule.when((label(first) == label(second)) & (label(final) != label(first)), "adjudicated_label differs from agreeing reviewers")
    for r in ROLES:
        rule = rule.when((arm == "unmatched") & (label(r) == "missed_match") & (number(r) == ""), f"{r}_company_number is missing")
        rule = rule.when((arm == "unmatched") & (label(r) == "true_unmatched") & (number(r) != ""), f"{r}_company_number must be blank")
        correct = (arm == "accepted") & (label(r) == "correct_match")
        rule = rule.when(correct & (F.col("matched_company_number") == ""), "no matched company number")
        rule = rule.when(correct & (number(r) != "") & (number(r) != F.col("matched_company_number")), f"{r}_company_number is not the match")
    missed = (arm == "unmatched") & (label(first) == "missed_match") & (label(second) == "missed_match") & (number(first) == number(second))
    return df.withColumn(name, rule.when(missed & (number(final) != number(first)), "adjudicated_company_number differs from agreeing reviewers"))


def stratum_faults(df: DataFrame) -> DataFrame:
    """One row a stratum with its sizes and ``fault``: the first thing wrong with its design columns, null if nothing is."""
    group = ["validation_arm", "sampling_stratum"]
    numeric = {c: F.col(c).cast("string").try_cast("double") for c in DESIGN[3:]}
    found = df.groupBy(*group).agg(F.count("*").alias("rows"), *(F.min(c).alias(f"{n}_least") for n, c in numeric.items()), *(F.max(c).alias(n) for n, c in numeric.items()), *(F.count_if(c.isNull() | F.isnan(c)).alias(f"{n}_bad") for n, c in numeric.items()))
    fault = F.when(F.trim(F.coalesce("sampling_stratum", F.lit(""))) == "", "blank stratum")
    for n in numeric:
        fault = fault.when((F.col(f"{n}_bad") > 0) | (F.col(f"{n}_least") != F.col(n)), f"{n} is not one number")
    population, sample = F.col("stratum_population_n"), F.col("stratum_sample_n")
    close = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))
    fault = fault.when((population != F.floor(population)) | (sample != F.floor(sample)) | (population <= 0) | (sample <= 0) | (sample > population) | (sample != F.col("rows")), "sizes are impossible")
    fault = fault.when(~close(F.col("inclusion_probability"), F.try_divide(sample, population)), "inclusion_probability is not sample by population")
    fault = fault.when(~close(F.col("sampling_weight"), F.try_divide(population, sample)), "sampling_weight is not population by sample")
    return found.select(*group, "rows", *numeric, fault.alias("fault"))


def validated(df: DataFrame) -> DataFrame:
    """The cleaned table; anything that breaks a rule raises with the first case by ID."""
    require_no_outcomes(df)
    require_columns(df, (*DESIGN, *REVIEW_COLUMNS), "adjudications")
    if df.isEmpty():
        raise DataError("adjudications are empty")
    require_unique(df, "ID", "adjudications")
    out = cleaned(df)
    unknown = out.where(~F.col("validation_arm").isin(*ARM_LABELS)).first()
    if unknown is not None:
        raise DataError(f"adjudications: unknown arm {unknown['validation_arm']!r}")
    fault = stratum_faults(out).where("fault IS NOT NULL").orderBy("validation_arm", "sampling_stratum").first()
    if fault is not None:
        raise DataError(f"adjudications: {fault['fault']} in {fault['validation_arm']}/{fault['sampling_stratum']}")
    broken = violation(out).where("violation IS NOT NULL").orderBy("ID").first()
    if broken is not None:
        raise DataError(f"adjudications: {broken['violation']} (ID {broken['ID']})")
    return out


def wilson(successes: Column, n: Column, z: Column | float) -> tuple[Column, Column]:
    """The Wilson score interval, within 0 and 1."""
    z = F.lit(z) if isinstance(z, float) else z
    p, z2 = successes / n, z * z
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    radius = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - radius), F.least(F.lit(1.0), centre + radius)


def strata(df: DataFrame) -> DataFrame:
    """One row a stratum: sizes, positives, the weighted total and share."""
    positive = F.when(F.col("validation_arm") == "accepted", ARM_LABELS["accepted"][0]).otherwise(ARM_LABELS["unmatched"][0])
    counted = df.groupBy("validation_arm", "sampling_stratum").agg(F.max(F.col("stratum_population_n").cast("long")).alias("stratum_population_n"), F.count("*").alias("stratum_sample_n"), F.count_if(F.col("adjudicated_label") == positive).alias("adjudicated_positive_n"))
    share = F.col("adjudicated_positive_n") / F.col("stratum_sample_n")
    return counted.withColumns({"weighted_positive_total": F.col("stratum_population_n") * F.col("adjudicated_positive_n") / F.col("stratum_sample_n"), "weighted_prevalence": share})


def weighted_prevalence(by_stratum: DataFrame, confidence: float) -> DataFrame:
    """One row an arm: the design-weighted share and its bounds, each stratum at the confidence that the number of strata asks for; a census is exact."""
    sizes = {r[0]: r[1] for r in by_stratum.groupBy("validation_arm").count().collect()}  # two arms at most
    z = F.lit(None).cast("double")
    for arm, n in sizes.items():
        z = F.when(F.col("validation_arm") == arm, NormalDist().inv_cdf(1 - (1 - confidence) / n / 2)).otherwise(z)
    low, high = wilson(F.col("adjudicated_positive_n"), F.col("stratum_sample_n"), z)
    census = F.col("stratum_sample_n") == F.col("stratum_population_n")
    bounded = by_stratum.withColumns({"low": F.when(census, F.col("weighted_prevalence")).otherwise(low), "high": F.when(census, F.col("weighted_prevalence")).otherwise(high)})
    of = lambda c: F.sum(F.col("stratum_population_n") * F.col(c)) / F.sum("stratum_population_n")
    return bounded.groupBy("validation_arm").agg(of("weighted_prevalence").alias("estimate"), of("low").alias("lower_ci"), of("high").alias("upper_ci"), F.sum("weighted_positive_total").alias("estimated_positive_total"), F.sum("stratum_population_n").alias("population_n"), F.sum("stratum_sample_n").alias("sample_n"))


def kappa(first: Column, second: Column) -> Column:
    """Aggregate: Cohen's kappa of two 0/1 columns, null where chance agreement is 1."""
    a, b = F.avg(first.cast("double")), F.avg(second.cast("double"))
    agreed, chance = F.avg((first == second).cast("double")), a * b + (1 - a) * (1 - b)
    return F.when(F.abs(chance - 1) > 1e-9, (agreed - chance) / (1 - chance))


def reviewer_agreement(df: DataFrame) -> DataFrame:
    """Rows reviewed, agreement of labels and of decisions, and kappa, for each arm and overall, in one pass over grouping sets."""
    positive = lambda r: (F.col(f"{r}_label") == F.when(F.col("validation_arm") == "accepted", ARM_LABELS["accepted"][0]).otherwise(ARM_LABELS["unmatched"][0])).cast("int")
    same = F.col("reviewer_1_label") == F.col("reviewer_2_label")
    missed = (F.col("validation_arm") == "unmatched") & (F.col("reviewer_1_label") == "missed_match")
    decided = F.when(missed, same & (F.col("reviewer_1_company_number") == F.col("reviewer_2_company_number"))).otherwise(same)
    rows = df.select("validation_arm", positive("reviewer_1").alias("a"), positive("reviewer_2").alias("b"), decided.cast("double").alias("d"))
    found = rows.rollup("validation_arm").agg(F.grouping("validation_arm").alias("g"), F.count("*").alias("reviewed_n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("label_agreement"), F.avg("d").alias("decision_agreement"), kappa(F.col("a"), F.col("b")).alias("cohen_kappa"))
    return found.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("validation_arm")).alias("validation_arm"), "reviewed_n", "label_agreement", "decision_agreement", "cohen_kappa")


def summary(df: DataFrame, confidence: float = 0.95, recall_supported: bool = False) -> dict[str, DataFrame]:
    """Precision, share of missed links and recall (only where its denominator is certified), agreement and strata."""
    if not 0 < confidence < 1:
        raise ValueError("a confidence lies between 0 and 1")
    table = validated(df)
    by_stratum = strata(table)
    arms = {r["validation_arm"]: r.asDict() for r in weighted_prevalence(by_stratum, confidence).collect()}  # two rows
    if set(arms) != set(ARM_LABELS):
        raise DataError("both arms must be reviewed")
    names = {"accepted": "accepted_match_precision", "unmatched": "unmatched_missed_link_prevalence"}
    fields = ("estimate", "lower_ci", "upper_ci", "estimated_positive_total", "population_n", "sample_n")
    rows = [(names[a], *(arms[a][f] for f in fields), "estimated", "") for a in ARM_LABELS]
    sizes = [arms["accepted"][f] + arms["unmatched"][f] for f in ("population_n", "sample_n")]
    true = arms["accepted"]["estimated_positive_total"] + arms["unmatched"]["estimated_positive_total"]
    if not recall_supported:
        recall = ("linkage_recall", None, None, None, None, *sizes, "not_estimated", "the recall denominator is not certified")
    elif true <= 0:
        recall = ("linkage_recall", None, None, None, None, *sizes, "not_estimated", "no true link is estimated")
    else:
        joint = {r["validation_arm"]: r for r in weighted_prevalence(by_stratum, 1 - (1 - confidence) / 2).collect()}
        links = {side: joint["accepted"][side] * arms["accepted"]["population_n"] for side in ("lower_ci", "upper_ci")}
        misses = {side: joint["unmatched"][side] * arms["unmatched"]["population_n"] for side in ("lower_ci", "upper_ci")}
        low = links["lower_ci"] / (links["lower_ci"] + misses["upper_ci"])
        high = links["upper_ci"] / (links["upper_ci"] + misses["lower_ci"])
        recall = ("linkage_recall", arms["accepted"]["estimated_positive_total"] / true, low, high, true, *sizes, "estimated", "")
    schema = "measure string, estimate double, lower_ci double, upper_ci double, estimated_positive_total double, population_n long, sample_n long, status string, reason string"
    return {"estimates": df.sparkSession.createDataFrame([*rows, recall], schema), "reviewer_agreement": reviewer_agreement(table), "stratum_estimates": by_stratum}


def require_membership(expected: DataFrame, completed: DataFrame) -> None:
    """A completed file must hold the frozen sample's rows, with its design and matches unchanged."""
    require_columns(completed, (*DESIGN, "matched_company_number"), "adjudications")
    text = ("validation_arm", "sampling_stratum", "matched_company_number")

    def keyed(df: DataFrame, side: str) -> DataFrame:
        own = df if "matched_company_number" in df.columns else df.withColumn("matched_company_number", F.lit(""))
        parts = {"validation_arm": clean_label(F.col("validation_arm")), "sampling_stratum": F.trim("sampling_stratum"), "matched_company_number": clean_company_number(F.col("matched_company_number"))}
        return own.select(F.trim(F.col("ID").cast("string")).alias("ID"), *(parts[c].alias(f"{side}_{c}") for c in text), *(F.col(c).cast("string").try_cast("double").alias(f"{side}_{c}") for c in DESIGN[3:]), F.lit(True).alias(f"{side}_here"))

    both = keyed(expected, "a").join(keyed(completed, "b"), "ID", "full_outer")
    near = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= 1e-12 + 1e-10 * F.abs(F.col(f"b_{c}"))
    rules = {"membership differs": F.col("a_here").isNull() | F.col("b_here").isNull()}
    rules |= {f"{c} was changed": ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in text}
    rules |= {f"{c} was changed": ~F.coalesce(near(c), F.lit(False)) for c in DESIGN[3:]}
    sound = both.agg(*(F.count_if(rule).alias(f"r{i}") for i, rule in enumerate(rules.values()))).first()
    for i, name in enumerate(rules):
        if sound[i]:
            raise DataError(f"adjudications: {name} ({sound[i]} rows)")


def load_completed(paths: dict[str, DataFrame], expected: dict[str, DataFrame]) -> DataFrame:
    """The completed arms as one table, each one validated and held against its frozen sample."""
    out = None
    for arm, table in paths.items():
        own = validated(table)
        if not own.where(F.col("validation_arm") != arm).isEmpty():
            raise DataError(f"the file of {arm} holds another arm")
        require_membership(expected[arm], own)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
