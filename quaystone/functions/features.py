"""Model features and report bands as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import days_between, months_before

#: Days in a month of the age basis; the register's own month has 30.44 days.
MONTH, REGISTER_MONTH = 365.25 / 12, 30.44
HORIZON, KNOTS = 48.0, (12.0, 24.0, 36.0)
LEAST_PROBABILITY = 1e-6

# Edges and names of the bands; a value on an edge belongs to the band above it, or below it for AGE_BANDS.
AMOUNT_BANDS = ((500, 1000, 5000, 25000), ("under_500", "500_999", "1000_4999", "5000_24999", "25000_plus"))
LAG_BANDS = ((0, 1, 2, 6, 31), ("before_judgment", "same_day", "one_day", "2_to_5_days", "6_to_30_days", "31_plus_days"))
AGE_AUDIT_BANDS = ((1, 12, 24, 36, 48, 72), ("up_to_1_month", "over_1_to_12_months", "over_12_to_24_months", "over_24_to_36_months", "over_36_to_48_months", "over_48_to_72_months", "over_72_months"))
AGE_BANDS = ((1, 12, 24, 36, 48), ("over_1_to_12", "over_12_to_24", "over_24_to_36", "over_36_to_48"))
STRATUM_BANDS = ((12, 24, 36), ("0", "1", "2", "3"))


def band(value: Column, edges: tuple[float, ...], names: tuple[str, ...], missing: str = "missing") -> Column:
    """Name of the left-closed band: below the first edge, between edges, from the last edge on."""
    out = F.when(value.isNull() | F.isnan(value.cast("double")), missing)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(value < edge, name)
    return out.otherwise(names[-1])


def right_closed_band(value: Column, edges: tuple[float, ...], names: tuple[str, ...], outside: str | None = "outside_or_missing") -> Column:
    """Name of the band (edge, next edge]; with ``outside`` None the ends are open and every value has a band."""
    if outside is None:
        out = F.when(value <= edges[0], names[0])
        for edge, name in zip(edges[1:], names[1:], strict=False):
            out = out.when(value <= edge, name)
        return out.otherwise(names[-1])
    out = F.when(value.isNull(), outside)
    for lo, hi, name in zip(edges, edges[1:], names, strict=False):
        out = out.when((value > lo) & (value <= hi), name)
    return out.otherwise(outside)


def age_basis(age_days: Column) -> dict[str, Column]:
    """Months of age, their square and cube on the horizon's scale, and cubes of the part beyond each knot."""
    months = age_days / F.lit(MONTH)
    out = {"observation_age_months": months, "observation_age_scaled_squared": F.pow(months / HORIZON, F.lit(2)), "observation_age_scaled_cubed": F.pow(months / HORIZON, F.lit(3))}
    return out | {f"observation_age_hinge_{knot:g}m_cubed": F.pow(F.greatest(months - knot, F.lit(0.0)) / HORIZON, F.lit(3)) for knot in KNOTS}


def amount_features(amount: Column) -> dict[str, Column]:
    """Logarithm of one plus the amount, and whether it is missing; a negative one counts as missing."""
    missing = amount.isNull() | F.isnan(amount) | (amount < 0)
    return {"log1p_judgment_amount": F.log1p(F.when(missing, 0.0).otherwise(amount)), "judgment_amount_missing": missing.cast("int")}


def company_age(day: Column, incorporated: Column) -> dict[str, Column]:
    """Years from incorporation to a day, null if negative or unknown, and a flag for that."""
    years = days_between(day, incorporated) / F.lit(365.25)
    known = F.when(years >= 0, years)
    return {"company_age_at_judgment_years": known, "company_age_at_judgment_missing": known.isNull().cast("int")}


def history_coverage(day: Column, start: Column, months: int = 24) -> Column:
    """Share of the months before a day that lie after the history's start; 0 without a start."""
    first = months_before(day, months)
    seen = F.greatest(days_between(day, F.greatest(first, start)), F.lit(0))
    return F.when(start.isNull(), 0.0).otherwise(F.least(F.greatest(seen / days_between(day, first), F.lit(0.0)), F.lit(1.0)))


def clip_probability(p: Column, least: float = LEAST_PROBABILITY) -> Column:
    return F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))


def logit(p: Column) -> Column:
    p = clip_probability(p)
    return F.ln(p / (1 - p))


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def snapshot_features(charges: Column, satisfied: Column, due: Column, observed: Column, status: Column) -> dict[str, Column]:
    """Charges and accounts of a company on a day: no charges give a satisfied share of 0, unknown ones null."""
    number = finite_or_null(F.trim(charges.cast("string")).try_cast("double"))
    paid = finite_or_null(F.trim(satisfied.cast("string")).try_cast("double"))
    ratio = F.try_divide(paid, F.when(number > 0, number))
    share = F.when(number == 0, 0.0).when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))
    return {
        "snapshot_any_charges": F.when(number.isNotNull(), (number > 0).cast("double")),
        "snapshot_n_charges": number,
        "snapshot_pct_charges_satisfied": share,
        "snapshot_accounts_overdue": F.when(due.isNotNull(), (due < observed).cast("double")),
        "snapshot_company_status_active": F.when(status.isNotNull(), (F.lower(F.trim(status)) == "active").cast("double")),
    }


def masked_count(n: Column, least: int) -> Column:
    """A report's count: ``<least`` for 0 to least - 1."""
    return F.when((n >= 0) & (n < least), F.lit(f"<{least}")).otherwise(F.format_number(n, 0))


def redacted_count(n: Column, least: int) -> Column:
    """A public log's count: null for 1 to least - 1; a zero stays."""
    return F.when((n > 0) & (n < least), F.lit(None)).otherwise(n)
