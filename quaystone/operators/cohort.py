"""The modelling cohort: filters with their funnel, features, splits by company, and masked test labels."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between, months_before, parse_date
from ..functions.features import STRATUM_BANDS, age_basis, amount_features, company_age, history_coverage, right_closed_band, snapshot_features
from ..functions.text import clean_label, same_text
from .checks import DataError, require_columns, require_none, require_unique
from .order import digest_bucket, with_position

SPLITS = ("train", "validation", "calibration", "test")
SHARES = (0.60, 0.15, 0.10, 0.15)
LABELS = ("Satisfied", "Unsatisfied")
# Names of the features.
AGE_FEATURES = ("observation_age_months", "observation_age_scaled_squared", "observation_age_scaled_cubed", "observation_age_hinge_12m_cubed", "observation_age_hinge_24m_cubed", "observation_age_hinge_36m_cubed")
HISTORY_FEATURES = ("observable_retained_prior_judgment_count_24m", "observable_retained_prior_judgment_value_24m", "days_since_observable_retained_prior_judgment_24m", "no_observable_retained_prior_judgment_24m", "observable_retained_history_calendar_coverage_24m")
PRIMARY_FEATURES = (*AGE_FEATURES, "company_age_at_judgment_years", "company_age_at_judgment_missing", "log1p_judgment_amount", "judgment_amount_missing", *HISTORY_FEATURES)
SNAPSHOT_FEATURES = ("snapshot_any_charges", "snapshot_n_charges", "snapshot_pct_charges_satisfied", "snapshot_accounts_overdue", "snapshot_company_status_active")
FAMILIES = {"age_only": AGE_FEATURES, "cross_sectional_primary": PRIMARY_FEATURES, "snapshot_exploratory": (*PRIMARY_FEATURES, *SNAPSHOT_FEATURES)}
# Headings under which a column may come, the preferred one first.
INCORPORATION_HEADINGS = ("incorporation_date", "IncorporationDate", "ch_incorporation_date", "CH_incorporation_date")
SNAPSHOT_HEADINGS = {
    "snapshot_any_charges": ("snapshot_any_charges", "any_charges"),
    "snapshot_n_charges": ("snapshot_n_charges", "n_charges", "n_mort_charges", "Mortgages.NumMortCharges"),
    "snapshot_pct_charges_satisfied": ("snapshot_pct_charges_satisfied", "pct_charges_satisfied"),
    "snapshot_accounts_overdue": ("snapshot_accounts_overdue", "accounts_overdue"),
    "snapshot_company_status_active": ("snapshot_company_status_active", "company_status_active"),
}


@dataclass
class Cohort:
    frame: DataFrame
    observed: dt.date
    funnel: dict[str, int]
    splits: DataFrame
    warnings: list[str]


def first_present(columns: list[str], headings: tuple[str, ...]) -> str | None:
    return next((h for h in headings if h in columns), None)


def age_window(day: Column, observed: Column, least_months: int = 1, most_months: int = 48) -> Column:
    """Whether a day lies in [observed - most, observed - least): the older edge belongs to it, the younger one doesn't."""
    return F.coalesce((day >= months_before(observed, most_months)) & (day < months_before(observed, least_months)), F.lit(False))


def conditions(observed: Column, least_months: int = 1, most_months: int = 48) -> dict[str, Column]:
    """The cohort's conditions on joined judgments and decisions."""
    return {
        "corporate": same_text(F.col("DefendantType"), "corporate"),
        "england_wales": same_text(F.col("Jurisdiction"), "england and wales"),
        "labelled": F.coalesce(F.col("JudgmentStatus").isin(*LABELS), F.lit(False)),
        "in_window": age_window(F.col("JudgmentDate"), observed, least_months, most_months),
        "exact_unique": F.coalesce(same_text(F.col("tier"), "exact_unique"), F.lit(False)),
        "has_company": F.trim(F.coalesce("matched_company_number", F.lit(""))) != "",
    }


def funnel(joined: DataFrame, c: dict[str, Column]) -> DataFrame:
    """One row of nested counts, in one pass."""
    ew = c["corporate"] & c["england_wales"]
    aged = ew & c["labelled"] & c["in_window"]
    kept = aged & c["exact_unique"] & c["has_company"]
    steps = {"judgments_read": F.lit(True), "valid_judgment_date": F.col("JudgmentDate").isNotNull(), "corporate": c["corporate"], "england_and_wales_corporate": ew, "satisfied_or_unsatisfied_corporate_ew": ew & c["labelled"], "primary_age_window_corporate_ew_labelled": aged, "exact_unique_matched_eligible_judgments": kept}
    companies = F.count_distinct(F.when(kept, F.trim("matched_company_number")))
    out = joined.agg(*(F.count_if(s).alias(n) for n, s in steps.items()), companies.alias("eligible_unique_companies"))
    rows = F.col("exact_unique_matched_eligible_judgments")
    return out.withColumns({"eligible_judgments": rows, "eligible_repeat_judgments": rows - F.col("eligible_unique_companies")})


def with_prior_history(df: DataFrame, company: str, day: str, amount: str, months: int = 24) -> DataFrame:
    """Add count, value and recency of the company's strictly earlier rows within the months before a row.

    The window takes the months up to the row's day; the day's own rows are taken off again, as a frame can't
    mix months and days. Recency is null without such a row. Amounts below 0 or missing count as 0.
    """
    n = days_between(F.col(day), F.lit("1900-01-01").cast("date"))
    df = df.withColumns({"__n": n, "__v": F.greatest(F.coalesce(amount, F.lit(0.0)), F.lit(0.0))})
    frame = f"PARTITION BY `{company}` ORDER BY `{day}` RANGE BETWEEN INTERVAL {months} MONTH PRECEDING AND CURRENT ROW"
    peers = f"PARTITION BY `{company}` ORDER BY `{day}` RANGE BETWEEN CURRENT ROW AND CURRENT ROW"
    earlier = Window.partitionBy(company).orderBy("__n").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max("__n").over(earlier)
    count = F.expr(f"count(*) OVER ({frame}) - count(*) OVER ({peers})")
    value = F.expr(f"coalesce(sum(__v) OVER ({frame}), 0) - coalesce(sum(__v) OVER ({peers}), 0)")
    out = df.withColumns({HISTORY_FEATURES[0]: count, "__value": value, "__last": last})
    recent = F.col(HISTORY_FEATURES[0]) > 0
    return out.withColumns({HISTORY_FEATURES[1]: F.when(recent, F.col("__value")).otherwise(0.0), HISTORY_FEATURES[2]: F.when(recent, (F.col("__n") - F.col("__last")).cast("double")), HISTORY_FEATURES[3]: (~recent).cast("int")}).drop("__n", "__v", "__value", "__last")


def split_sizes(n: Column) -> list[Column]:
    """Sizes of the four splits of n companies: whole parts, and one more for the largest remainders, ties in split order."""
    exact = [n * F.lit(share) for share in SHARES]
    least = [F.floor(x) for x in exact]
    rest = [x - y for x, y in zip(exact, least, strict=True)]
    spare = n - sum(least[1:], least[0])
    before = [sum((F.when((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i)), 1).otherwise(0) for j in range(len(SHARES)) if j != i), F.lit(0)) for i in range(len(SHARES))]
    return [least[i] + F.when(before[i] < spare, 1).otherwise(0) for i in range(len(SHARES))]


def company_splits(df: DataFrame, company: str = "matched_company_number", age: str = "observation_age_months", seed: int = 20260619) -> DataFrame:
    """One row a company: its split. Companies are taken by digest inside four strata of their median age; labels aren't read."""
    own = df.groupBy(F.col(company).cast("string").alias(company)).agg(F.median(F.col(age).cast("double")).alias("__age"))
    digest = F.sha2(F.concat(F.lit(str(seed)), F.char(F.lit(0)), F.col(company)), 256)
    keyed = own.withColumns({"__stratum": right_closed_band(F.col("__age"), *STRATUM_BANDS, outside=None), "__digest": digest})
    placed = with_position(keyed, ["__stratum"], digest_bucket(F.col("__digest")), [F.col("__digest"), F.col(company)], "__at")
    sizes = keyed.groupBy("__stratum").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__stratum", *(c.alias(f"__s{i}") for i, c in enumerate(split_sizes(F.col("__n")))))
    joined = placed.join(F.broadcast(sizes), "__stratum")
    at, edge, split = F.col("__at"), F.lit(0), F.lit(SPLITS[-1])
    rule = None
    for i, name in enumerate(SPLITS[:-1]):
        edge = edge + F.col(f"__s{i}")
        rule = F.when(at < edge, name) if rule is None else rule.when(at < edge, name)
    return joined.select(company, rule.otherwise(split).alias("split"))


def with_company_splits(df: DataFrame, company: str = "matched_company_number", age: str = "observation_age_months", seed: int = 20260619) -> DataFrame:
    require_columns(df, (company, age), "cohort")
    require_none(df, {f"{company} is missing": F.col(company).isNull(), f"{age} is missing": F.col(age).isNull()}, "cohort")
    return df.drop("split").withColumn(company, F.col(company).cast("string")).join(company_splits(df, company, age, seed), company)


def with_chronological_splits(df: DataFrame, company: str = "matched_company_number", day: str = "JudgmentDate") -> DataFrame:
    """Splits by day, none divided: each boundary is the day that brings the rows nearest to the target, and every split keeps a day.

    One row a company. With fewer days than splits, days take the splits in order.
    """
    require_unique(df, company, "cohort")
    require_none(df, {f"{day} is missing": F.col(day).isNull()}, "cohort")
    sizes = df.groupBy(day).agg(F.count("*").alias("n")).orderBy(day).collect()  # one row a day
    total, sums, days = 0, [], [r[day] for r in sizes]
    for r in sizes:
        total += r["n"]
        sums.append(total)
    ends, least = [], 0
    for i in range(len(SPLITS) - 1):
        target = sum(SHARES[: i + 1]) * total
        open_ = range(least + 1, len(days) - (len(SPLITS) - 1 - i) + 1) if len(days) >= len(SPLITS) else [min(i + 1, len(days))]
        least = min(open_, key=lambda k: (abs(sums[k - 1] - target), k)) if len(days) else 0
        ends.append(least)
    rule = F.lit(SPLITS[-1])
    for name, end in reversed(list(zip(SPLITS, ends, strict=False))):
        if end:
            rule = F.when(F.col(day) <= F.lit(days[end - 1]), name).otherwise(rule)
    return df.withColumn("split", rule)


def split_counts(df: DataFrame, company: str = "matched_company_number", age: str = "observation_age_months") -> DataFrame:
    """Rows, companies and mean age of each of the four splits, zeros for one without rows."""
    counted = df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(company).alias("unique_companies"), F.avg(F.col(age).cast("double")).alias("mean_observation_age_months"))
    domain = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return domain.join(counted, "split", "left").na.fill(0, ["rows", "unique_companies"])


def split_faults(df: DataFrame, company: str = "matched_company_number") -> DataFrame:
    """One row: companies in several splits, rows with an unknown split."""
    own = df.groupBy(company).agg(F.count_distinct("split").alias("n"), F.count_if(~F.col("split").isin(*SPLITS)).alias("unknown"))
    return own.agg(F.count_if(F.col("n") > 1).alias("crossing_companies"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_rows"))


def require_sound_splits(df: DataFrame, company: str = "matched_company_number") -> None:
    row = split_faults(df, company).first()
    if row["unknown_rows"]:
        raise DataError(f"cohort: {row['unknown_rows']} rows have an unknown split")
    if row["crossing_companies"]:
        raise DataError(f"cohort: {row['crossing_companies']} companies are in several splits")


def masked_label(split: Column, status: Column) -> Column:
    """1 for Satisfied, 0 otherwise, null on the test split."""
    return F.when(split != "test", (status == LABELS[0]).cast("int"))


def with_snapshot_features(df: DataFrame, observed: Column) -> DataFrame:
    """Add the snapshot features: a column that has values under one of its headings is taken, others are derived from the register's columns."""
    given = {name: first_present(df.columns, headings) for name, headings in SNAPSHOT_HEADINGS.items()}
    named = {name: h for name, h in given.items() if h}
    filled = df.agg(*(F.count(F.col(f"`{h}`").cast("string").try_cast("double")).alias(n) for n, h in named.items())).first() if named else {}
    raw = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    derived = snapshot_features(raw("Mortgages.NumMortCharges"), raw("Mortgages.NumMortSatisfied"), parse_date(raw("Accounts.NextDueDate")), observed, raw("CompanyStatus"))
    own = lambda n: F.col(f"`{named[n]}`").cast("string").try_cast("double")
    return df.withColumns({n: own(n) if n in named and filled[n] else derived[n] for n in SNAPSHOT_HEADINGS})


def model_decisions(decisions: DataFrame) -> DataFrame:
    """The decisions' columns that modelling needs; what must hold of them raises if it doesn't."""
    if "match_tier" in decisions.columns:
        raise DataError("decisions hold the former column match_tier")
    require_columns(decisions, ("ID", "matched_company_number", "tier"), "decisions")
    require_unique(decisions, "ID", "decisions")
    incorporated = first_present(decisions.columns, INCORPORATION_HEADINGS)
    if incorporated is None:
        raise DataError("decisions: no incorporation day")
    wanted = [incorporated, *(h for headings in SNAPSHOT_HEADINGS.values() for h in headings), "Mortgages.NumMortSatisfied", "Accounts.NextDueDate", "CompanyStatus"]
    own = decisions.select("ID", "matched_company_number", "tier", *(F.col(f"`{c}`") for c in dict.fromkeys(wanted) if c in decisions.columns))
    own = own.withColumn("__incorporated", parse_date(F.col(incorporated)))
    tier, linked = clean_label(F.col("tier")), same_text(F.col("tier"), "exact_unique")
    rules = {"tier is missing": tier == "", "tier is unknown": ~tier.isin("exact_unique", "unmatched"), "a linked row has no company number": linked & (F.trim(F.coalesce("matched_company_number", F.lit(""))) == ""), "a linked row has no incorporation day": linked & F.col("__incorporated").isNull()}
    require_none(own, rules, "decisions")
    return own


def prepare(judgments: DataFrame, decisions: DataFrame, observed: dt.date, seed: int = 20260619, least_months: int = 1, most_months: int = 48, history_months: int = 24) -> Cohort:
    """The cohort with features, splits and masked labels. History is taken from all linked corporate rows before the filters."""
    require_columns(judgments, ("ID", "JudgmentDate", "JudgmentStatus", "DefendantType", "Jurisdiction"), "judgments")
    require_unique(judgments, "ID", "judgments")
    amount = F.col("Amount").cast("double") if "Amount" in judgments.columns else F.lit(None).cast("double")
    day = F.lit(observed)
    left = judgments.select("ID", parse_date(F.col("JudgmentDate")).alias("JudgmentDate"), "JudgmentStatus", "DefendantType", "Jurisdiction", F.when(amount >= 0, amount).alias("__amount"))
    joined = left.join(model_decisions(decisions), "ID", "left")
    c = conditions(day, least_months, most_months)
    steps = funnel(joined, c).first().asDict()
    if not steps["eligible_judgments"]:
        raise DataError("cohort: no row remains")
    history = joined.where(c["corporate"] & c["england_wales"] & c["exact_unique"] & c["has_company"] & F.col("JudgmentDate").isNotNull()).withColumn("matched_company_number", F.trim("matched_company_number"))
    start = history.agg(F.min("JudgmentDate")).first()[0]
    # The cohort's rows are rows of the history, so its window is taken once and filtered.
    aged = with_prior_history(history, "matched_company_number", "JudgmentDate", "__amount", history_months).where(c["labelled"] & c["in_window"])
    features = {**age_basis(days_between(day, F.col("JudgmentDate"))), **company_age(F.col("JudgmentDate"), F.col("__incorporated")), **amount_features(F.col("__amount")), HISTORY_FEATURES[4]: history_coverage(F.col("JudgmentDate"), F.lit(start), history_months)}
    featured = with_snapshot_features(aged.withColumns(features), day)
    split = with_company_splits(featured, seed=seed)
    frame = split.select("ID", "matched_company_number", "JudgmentDate", masked_label(F.col("split"), F.col("JudgmentStatus")).alias("label"), "split", *PRIMARY_FEATURES, *SNAPSHOT_FEATURES)
    require_sound_splits(frame)
    filled = frame.agg(F.count("log1p_judgment_amount").alias("n"), F.min("judgment_amount_missing").alias("no_amount"), *(F.count(n).alias(n) for n in SNAPSHOT_FEATURES)).first()
    warnings = ["no judgment has an amount"] if filled["no_amount"] else []
    if empty := [n for n in SNAPSHOT_FEATURES if not filled[n]]:
        warnings.append(f"without any value: {', '.join(empty)}")
    warnings.append("prior history counts retained, linked records alone; its coverage is of the calendar, not of the company's record")
    warnings.append("snapshot features describe the company on the snapshot's day")
    return Cohort(frame, observed, steps, split_counts(frame), warnings)


def locked_labels(judgments: DataFrame, cohort: Cohort) -> DataFrame:
    """ID and label of the test rows, the one place where their status is read; to be called behind the release gate."""
    test = cohort.frame.where(F.col("split") == "test").select("ID").join(judgments.select("ID", "JudgmentStatus"), "ID", "left")
    require_none(test, {"a test row has no binary status": ~F.coalesce(F.col("JudgmentStatus").isin(*LABELS), F.lit(False))}, "locked labels")
    return test.select("ID", (F.col("JudgmentStatus") == LABELS[0]).cast("int").alias("label"))
