"""Linkage of judgments to companies by one unique, date-valid name.

Three equi-joins and two aggregates, no index and no row loop: names of companies are grouped to one row a
(company, name) with that name's periods, source names meet them by name, and each judgment's candidates
are reduced first to one row a company and then to one row a judgment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name, normalize_postcode
from .checks import DataError, require_unique

TIERS = ("exact_unique", "unmatched")
GUARDS = ("candidate_companies_rejected_post_incorporation", "judgments_with_post_incorporation_rejection", "accepted_matches_missing_incorporation_date", "judgments_blocked_by_incomplete_name_history")


def deduplicated(companies: DataFrame, key: str = "company_number") -> DataFrame:
    """Companies with a number, identical rows once; rows that share a number and differ raise."""
    known = companies.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").withColumn(key, F.upper(F.trim(F.col(key)))).dropDuplicates()
    conflict = known.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").first()
    if conflict is not None:
        raise DataError(f"company {conflict[key]} has rows that differ")
    return known


def former_names(companies: DataFrame, key: str = "company_number", names: str = "former_names") -> DataFrame:
    """One row a former name with text in it: company, raw name, name, change day."""
    rows = companies.select(key, F.explode(names).alias("f")).select(key, F.trim("f.raw_name").alias("raw_name"), F.col("f.change_date").alias("change_date"))
    return rows.withColumn("name", normalize_name(F.col("raw_name"))).where("name <> ''")


def name_periods(companies: DataFrame, key: str = "company_number", names: str = "former_names") -> tuple[DataFrame, DataFrame]:
    """(periods, history): half-open periods of each company's names, and its counts of undated and invalid changes.

    A former name ends on its change day and starts on the change before, or on incorporation; the current
    one starts on the last change. A change on or before incorporation, or on a day that an earlier name (in
    order of names) has taken, is invalid.
    """
    former = former_names(companies, key, names).join(companies.select(key, "incorporation_date"), key)
    undated = F.col("change_date").isNull()
    early = F.coalesce(F.col("change_date") <= F.col("incorporation_date"), F.lit(False))
    usable = former.where(~undated & ~early).withColumn("__at", F.row_number().over(Window.partitionBy(key, "change_date").orderBy("name", "raw_name")))
    kept = usable.where("__at = 1")
    by_day = Window.partitionBy(key).orderBy("change_date")
    old = kept.select(key, "raw_name", "name", F.coalesce(F.lag("change_date").over(by_day), "incorporation_date").alias("valid_from"), F.col("change_date").alias("valid_to"), F.lit("former").alias("kind"))
    last = kept.groupBy(key).agg(F.max("change_date").alias("__last"), F.count("*").alias("__dated"))
    current = companies.select(key, F.trim("company_name").alias("raw_name"), normalize_name(F.col("company_name")).alias("name"), "incorporation_date").join(last, key, "left")
    current = current.where("name <> ''").select(key, "raw_name", "name", F.coalesce("__last", "incorporation_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("current").alias("kind"))
    counts = former.groupBy(key).agg(F.count("*").alias("__given"), F.count_if(undated).alias("undated")).join(last.select(key, "__dated"), key, "left")
    history = counts.select(key, "undated", (F.col("__given") - F.col("undated") - F.coalesce("__dated", F.lit(0))).alias("invalid"))
    return old.unionByName(current), history


def candidate_companies(companies: DataFrame, judgments: DataFrame, names: str = "former_names") -> DataFrame:
    """Companies of which the current or a former name is a source name of any judgment; the others can't be linked."""
    wanted = source_names(judgments).select("name").distinct()
    own = companies.select("company_number", normalize_name(F.col("company_name")).alias("name")).union(former_names(companies, names=names).select("company_number", "name"))
    return companies.join(own.join(wanted, "name", "left_semi").select("company_number").distinct(), "company_number", "left_semi")


def source_names(judgments: DataFrame) -> DataFrame:
    """One row a judgment and field with a name: ID, JudgmentDate, field, name."""
    trading = F.col("trading_name") if "trading_name" in judgments.columns else F.lit("")
    fields = F.array(F.struct(F.lit("company_name").alias("field"), F.col("company_name").alias("raw")), F.struct(F.lit("trading_name").alias("field"), trading.alias("raw")))
    rows = judgments.select("ID", "JudgmentDate", F.explode(fields).alias("s"))
    return rows.select("ID", "JudgmentDate", "s.field", normalize_name(F.col("s.raw")).alias("name")).where("name <> ''")


def company_names(companies: DataFrame, names: str = "former_names") -> DataFrame:
    """One row a (company, name), of current, former and unplaced names: the company's facts and the name's periods."""
    periods, history = name_periods(companies, names=names)
    unplaced = former_names(companies, names=names).select("company_number", "name", F.lit(None).alias("period"))
    placed = periods.select("company_number", "name", F.struct("valid_from", "valid_to", "kind", "raw_name").alias("period"))
    grouped = placed.union(unplaced.select("company_number", "name", F.col("period").cast(placed.schema["period"].dataType))).groupBy("company_number", "name").agg(F.collect_list("period").alias("periods"))
    facts = companies.join(history, "company_number", "left").select("company_number", "incorporation_date", (F.coalesce("undated", F.lit(0)) + F.coalesce("invalid", F.lit(0)) == 0).alias("complete"))
    return grouped.join(facts, "company_number")


def match(judgments: DataFrame, companies: DataFrame, names: str = "former_names", snapshot: tuple[str, ...] = ()) -> DataFrame:
    """One decision a judgment (ID, JudgmentDate, company_name, trading_name, postcode).

    ``companies`` has company_number, company_name, postcode, incorporation_date, former names (array of raw_name and
    change_date) and the snapshot columns to carry to linked rows. A company without incorporation day, or
    with an undated or invalid former name, can't be verified: it blocks the others and is never accepted.
    """
    day = F.col("JudgmentDate")
    names_of = company_names(companies, names)
    met = source_names(judgments).join(names_of, "name")
    held = F.filter("periods", lambda p: (p["valid_from"].isNull() | (p["valid_from"] <= day)) & (p["valid_to"].isNull() | (day < p["valid_to"])))
    state = F.when(F.col("incorporation_date").isNull(), "missing").when(~F.col("complete"), "incomplete").when(day < F.col("incorporation_date"), "rejected").when(F.size(held) > 0, "valid").otherwise("none")
    classed = met.withColumn("state", state).withColumn("place", F.when(F.col("state") == "valid", F.struct("field", F.array_min(F.transform(held, lambda p: F.struct(p["kind"].alias("kind"), p["raw_name"].alias("raw_name")))).alias("period"))))
    # One row a judgment and company before anything is counted: no distinct counts, no expansion.
    pairs = classed.groupBy("ID", "company_number").agg(F.min("place").alias("place"), F.max(F.when(F.col("state") != "none", F.col("state"))).alias("state"))
    count = lambda s: F.count_if(F.col("state") == s)
    found = pairs.groupBy("ID").agg(count("valid").alias("valid"), count("missing").alias("missing"), count("incomplete").alias("incomplete"), count("rejected").alias("rejected"), F.min(F.when(F.col("state") == "valid", F.struct("company_number", "place"))).alias("best"))
    trading = F.col("trading_name") if "trading_name" in judgments.columns else F.lit("")
    base = judgments.select("ID", "JudgmentDate", F.col("company_name").alias("source_company_name"), trading.alias("source_trading_name"), F.col("postcode").alias("source_postcode"))
    joined = base.join(found, "ID", "left")
    unresolved = F.coalesce(F.col("missing") + F.col("incomplete"), F.lit(0))
    accepted = F.coalesce((F.col("valid") == 1) & (unresolved == 0), F.lit(False))
    joined = joined.withColumns({"accepted": accepted, "matched_company_number": F.when(accepted, F.col("best.company_number"))})
    carried = companies.select(F.col("company_number").alias("matched_company_number"), F.trim("company_name").alias("matched_company_name"), normalize_postcode(F.col("postcode")).alias("matched_company_postcode"), F.col("incorporation_date").alias("IncorporationDate"), *(F.col(f"`{c}`") for c in snapshot))
    out = joined.join(carried, "matched_company_number", "left")
    own, named = normalize_postcode(F.col("source_postcode")), (normalize_name(F.col("source_company_name")) != "") | (normalize_name(F.col("source_trading_name")) != "")
    number = F.coalesce(F.col("valid") + unresolved, F.lit(0))
    reason = (
        F.when(F.col("accepted"), F.when(own == "", "unique_exact_name_postcode_missing").when(own == F.col("matched_company_postcode"), "unique_exact_name_postcode_agrees").otherwise("unique_exact_name_postcode_differs"))
        .when(~named, "missing_name")
        .when(number > 1, "exact_name_not_uniquely_verifiable")
        .when(F.col("rejected") > 0, "exact_name_post_incorporation")
        .when(F.col("missing") > 0, "exact_name_missing_incorporation_date")
        .when(F.col("incomplete") > 0, "exact_name_incomplete_name_history")
        .otherwise("no_date_valid_unique_exact_name")
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "ID",
        F.when(F.col("accepted"), TIERS[0]).otherwise(TIERS[1]).alias("tier"),
        reason.alias("reason"),
        text(F.col("matched_company_number")).alias("matched_company_number"),
        text(F.col("matched_company_name")).alias("matched_company_name"),
        text(F.col("matched_company_postcode")).alias("matched_company_postcode"),
        text(F.when(F.col("accepted"), F.col("best.place.period.raw_name"))).alias("matched_name"),
        text(F.when(F.col("accepted"), F.col("best.place.period.kind"))).alias("matched_name_kind"),
        text(F.when(F.col("accepted"), F.col("best.place.field"))).alias("matched_on"),
        (F.col("accepted") & (own != "") & F.coalesce(own == F.col("matched_company_postcode"), F.lit(False))).alias("postcode_agrees"),
        number.cast("long").alias("exact_name_candidate_count"),
        F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected_post_incorporation"),
        (F.coalesce("missing", F.lit(0)) > 0).alias("incorporation_date_missing"),
        (F.coalesce("incomplete", F.lit(0)) > 0).alias("name_history_incomplete"),
        "source_company_name",
        "source_trading_name",
        "source_postcode",
        "IncorporationDate",
        *(F.col(f"`{c}`") for c in snapshot),
    )


def match_checked(judgments: DataFrame, companies: DataFrame, **options) -> DataFrame:
    """As ``match``, after checks that IDs are unique and days known, and that companies don't conflict."""
    require_unique(judgments, "ID", "judgments")
    if not judgments.where("JudgmentDate IS NULL").isEmpty():
        raise DataError("judgments: a JudgmentDate can't be read")
    return match(judgments, deduplicated(companies), **options)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value; a null reads ``missing``."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias(column)).agg(F.count("*").alias("rows"))
    total = counted.agg(F.greatest(F.coalesce(F.sum("rows"), F.lit(0)), F.lit(1)).alias("__all"))
    return counted.join(F.broadcast(total)).select(column, "rows", (F.col("rows") / F.col("__all")).alias("share"))


def over_domain(counted: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """The rows of a count table for each value of a domain, zeros for those without."""
    values = counted.sparkSession.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{column} string, __at int")
    return values.join(counted, column, "left").na.fill(0).orderBy("__at").drop("__at")


def guard_counts(decisions: DataFrame) -> DataFrame:
    """Four rows (guard, rows) from one aggregate."""
    sums = decisions.agg(
        F.coalesce(F.sum("rejected_post_incorporation"), F.lit(0)).cast("long").alias("g0"),
        F.count_if(F.col("rejected_post_incorporation") > 0).alias("g1"),
        F.count_if((F.col("tier") != TIERS[1]) & F.col("incorporation_date_missing")).alias("g2"),
        F.count_if("name_history_incomplete").alias("g3"),
    )
    stack = ", ".join(f"'{g}', g{i}" for i, g in enumerate(GUARDS))
    return sums.select(F.expr(f"stack({len(GUARDS)}, {stack}) AS (guard, rows)"))


def diagnostics(judgments: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Counts of decisions without identifiers: coverage, reasons, methods, by type, by year, guards."""
    facts = [c for c in ("DefendantType", "JudgmentDate") if c in judgments.columns]
    joined = judgments.select("ID", *facts).join(decisions.drop(*facts), "ID", "left")
    if not joined.where("tier IS NULL").isEmpty():
        raise DataError("decisions don't cover every judgment")
    unmatched = joined.where(F.col("tier") == TIERS[1])
    out = {
        "tier_counts": over_domain(shares(joined, "tier"), "tier", TIERS),
        "unmatched_reasons": shares(unmatched, "reason").orderBy("reason"),
        "method_counts": joined.where(F.col("tier") != TIERS[1]).groupBy("tier", "matched_on", "matched_name_kind").agg(F.count("*").alias("rows")),
        "guard_counts": guard_counts(joined),
    }
    if "DefendantType" in facts:
        out["by_defendant_type"] = joined.groupBy("DefendantType", "tier").agg(F.count("*").alias("rows"))
    if "JudgmentDate" in facts:
        year = F.coalesce(F.year("JudgmentDate").cast("string"), F.lit("missing"))
        out["by_judgment_vintage"] = joined.groupBy(year.alias("judgment_year"), "tier").agg(F.count("*").alias("rows"))
    return out


def linkage_target(judgments: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corporate judgments of England and Wales and their decisions, one each."""
    target = judgments.where((F.col("DefendantType") == "Corporate") & (F.col("Jurisdiction") == "England and Wales"))
    own = decisions.join(target.select("ID"), "ID", "left_semi")
    if target.count() != own.count():
        raise DataError("the linkage target needs one decision a judgment")
    return target, own


def matching_funnel(judgments: DataFrame, decisions: DataFrame, accepted_sample: DataFrame, unmatched_sample: DataFrame) -> DataFrame:
    """Six stages (stage, rows): judgments and decisions, linked and unmatched ones, and the two samples."""
    count = lambda df, name, condition=None: df.agg((F.count_if(condition) if condition is not None else F.count("*")).alias("rows")).select(F.lit(name).alias("stage"), "rows")
    parts = [
        count(judgments, "judgments_read"),
        count(decisions, "matching_decisions"),
        count(decisions, "unique_exact_name", F.col("tier") == TIERS[0]),
        count(decisions, "unmatched", F.col("tier") == TIERS[1]),
        count(accepted_sample, "accepted_validation_sample"),
        count(unmatched_sample, "unmatched_validation_sample"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
