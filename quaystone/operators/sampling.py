"""Probability samples with their design: systematic over ordered strata, and hashed ranks inside strata.

The random permutation is a seeded SHA-256 of the row's key, so a sample depends on the data and the seed
alone, not on partitions. Positions come from ``order.with_position``; no task sorts all rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canon_header, composite_key
from .checks import DataError, require_columns, require_unique
from .linkage import TIERS
from .order import digest_bucket, with_position

REVIEW_COLUMNS = ("reviewer_1_label", "reviewer_1_company_number", "reviewer_2_label", "reviewer_2_company_number", "adjudicated_label", "adjudicated_company_number", "adjudication_notes")
# Canonical headings of outcomes, which no audit file may hold.
OUTCOME_HEADINGS = ("judgmentstatus", "satisfactiondate", "cancellationdate", "cancellationreason", "companystatus", "outcome", "target", "issatisfied", "satisfied", "unsatisfied", "y")
PAIR_COLUMNS = ("ID", "source_company_name", "source_trading_name", "source_postcode", "matched_company_name", "matched_name", "matched_name_kind", "matched_company_number", "matched_company_postcode", "IncorporationDate", "tier", "match_method", "matched_on", "postcode_agrees", "JudgmentDate")


def rank_digest(seed: int, label: Column | str, identifier: Column, company: Column | str = "") -> Column:
    part = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), part(label), identifier.cast("string"), part(company)), 256)


def start_fraction(seed: int, label: str) -> float:
    """The random start of a systematic draw, in [0, 1)."""
    return int(hashlib.sha256(f"{seed}|{label}|systematic-start".encode()).hexdigest()[:16], 16) / 2.0**64


def systematic(df: DataFrame, count: int, stratum: str, digest: str, key: str, seed: int, label: str) -> DataFrame:
    """``count`` rows at equal steps, from a hashed start, through all rows in order of stratum and digest; all rows if there are no more."""
    if count <= 0:
        return df.limit(0)
    total = df.count()
    if count >= total:
        return df
    placed = with_position(df, [], F.struct(F.col(stratum), digest_bucket(F.col(digest))), [F.col(digest), F.col(key)], "__position")
    step, start = total / count, start_fraction(seed, label)
    # The draw that could have taken a position, by the inverse of its formula; its neighbours cover rounding.
    guess = F.ceil(F.col("__position") / step - start)
    takes = lambda i: (i >= 0) & (i < count) & (F.floor((start + i) * step) == F.col("__position"))
    return placed.where(takes(guess - 1) | takes(guess) | takes(guess + 1)).drop("__position")


def allocate(populations: dict[str, int], target: int) -> dict[str, int]:
    """Rows to draw from each stratum: one each, the rest in proportion to what is left, to the target or the population.

    Whole parts are given round by round; where a round gives none, single rows go to the largest fractions, ties
    in order of the stratum. Raises if the target is below the number of strata.
    """
    total = sum(populations.values())
    target = min(target, total)
    if target < len(populations):
        raise DataError(f"{len(populations)} strata need a sample of as many rows at least")
    given = dict.fromkeys(sorted(populations), 1)
    while (left := target - sum(given.values())) > 0:
        room = {k: populations[k] - n for k, n in given.items()}
        ideal = {k: float(r) * left / sum(room.values()) for k, r in room.items()}
        extra = {k: min(math.floor(x), room[k]) for k, x in ideal.items()}
        if not any(extra.values()):
            open_ = sorted((k for k in room if room[k] > 0), key=lambda k: (-(ideal[k] % 1), k))
            extra = dict.fromkeys(open_[:left], 1)
        for k, n in extra.items():
            given[k] += n
    return given


def require_no_outcomes(df: DataFrame) -> None:
    found = sorted(c for c in df.columns if canon_header(c) in OUTCOME_HEADINGS)
    if found:
        raise DataError(f"an audit file may not hold {', '.join(found)}")


def with_design(df: DataFrame, population: Column, sample: Column) -> DataFrame:
    """Add the stratum's sizes, the inclusion probability and the weight of each row, and empty review columns."""
    sized = df.withColumns({"stratum_population_n": population.cast("long"), "stratum_sample_n": sample.cast("long")})
    sized = sized.withColumns({"inclusion_probability": F.col("stratum_sample_n") / F.col("stratum_population_n"), "sampling_weight": F.col("stratum_population_n") / F.col("stratum_sample_n")})
    return sized.withColumns({c: F.lit("") for c in REVIEW_COLUMNS})


def pair_sample(judgments: DataFrame, decisions: DataFrame, size: int, seed: int) -> DataFrame:
    """A systematic sample of linked judgments, spread over source, kind, reason, postcode and year; too few raise."""
    require_columns(decisions, ("ID", "tier", "reason", "matched_company_number", "matched_name_kind", "matched_on", "postcode_agrees", "source_company_name", "source_trading_name", "source_postcode"), "decisions")
    linked = decisions.where(F.col("tier") == TIERS[0])
    require_unique(linked, "ID", "decisions")
    if (found := linked.count()) < size:
        raise DataError(f"{found} linked judgments are fewer than the sample's {size}")
    dated = linked.join(judgments.select("ID", "JudgmentDate"), "ID", "left")
    agrees = F.initcap(F.col("postcode_agrees").cast("string"))
    keyed = dated.withColumns({"__stratum": composite_key(F.col("matched_on"), F.col("matched_name_kind"), F.col("reason"), agrees, F.year("JudgmentDate")), "__rank": rank_digest(seed, F.col("tier"), F.col("ID"), F.col("matched_company_number"))})
    # Only keys are ranked; the wide rows are fetched for the drawn ones.
    drawn = systematic(keyed.select("ID", "__stratum", "__rank"), size, "__stratum", "__rank", "ID", seed, TIERS[0])
    out = dated.join(F.broadcast(drawn.select("ID")) if size <= 10_000 else drawn.select("ID"), "ID", "left_semi").withColumn("match_method", F.col("reason"))
    return out.select(*(c for c in PAIR_COLUMNS if c in out.columns))


def accepted_sample(judgments: DataFrame, decisions: DataFrame, size: int, seed: int) -> DataFrame:
    """The pair sample with its design and review columns."""
    population = decisions.where(F.col("tier") == TIERS[0]).count()
    pairs = pair_sample(judgments, decisions, size, seed)
    drawn = min(size, population)
    labelled = pairs.withColumns({"validation_arm": F.lit("accepted"), "sampling_design": F.lit("equal_probability_systematic"), "sampling_stratum": F.lit("tier=exact_unique")})
    if "Defendant Address" in judgments.columns:
        labelled = labelled.join(judgments.select("ID", F.col("Defendant Address").alias("source_address")), "ID", "left")
    out = with_design(labelled, F.lit(population), F.lit(drawn))
    require_no_outcomes(out)
    return out


def unmatched_sample(judgments: DataFrame, decisions: DataFrame, size: int, seed: int) -> DataFrame:
    """Ranked rows of every stratum (reason and year) of the unmatched, as many as it is allocated."""
    if size <= 0:
        raise DataError("an unmatched sample needs a positive size")
    kept = [c for c in ("ID", "tier", "reason", "source_company_name", "source_trading_name", "source_postcode", "exact_name_candidate_count", "rejected_post_incorporation", "incorporation_date_missing", "name_history_incomplete") if c in decisions.columns]
    address = ["Defendant Address"] if "Defendant Address" in judgments.columns else []
    rows = decisions.where(F.col("tier") == TIERS[1]).select(*kept).join(judgments.select("ID", "JudgmentDate", *address), "ID", "left")
    if address:
        rows = rows.withColumnRenamed("Defendant Address", "source_address")
    require_unique(rows, "ID", "decisions")
    if not rows.where("JudgmentDate IS NULL").isEmpty():
        raise DataError("every unmatched judgment needs a JudgmentDate")
    stratum = F.concat(F.lit("reason="), F.coalesce("reason", F.lit("missing")), F.lit("|judgment_year="), F.year("JudgmentDate").cast("string"))
    rows = rows.withColumn("sampling_stratum", stratum)
    populations = {r[0]: r[1] for r in rows.groupBy("sampling_stratum").count().collect()}  # one row a reason and year
    if not populations:
        raise DataError("there is no unmatched judgment")
    sizes = [(k, n, populations[k]) for k, n in allocate(populations, size).items()]
    design = rows.sparkSession.createDataFrame(sizes, "sampling_stratum string, __take long, __all long")
    ranked = rows.withColumn("__rank", rank_digest(seed, F.concat(F.lit("unmatched|"), F.col("sampling_stratum")), F.col("ID")))
    placed = with_position(ranked, ["sampling_stratum"], digest_bucket(F.col("__rank")), [F.col("__rank"), F.col("ID")], "__at")
    drawn = placed.join(F.broadcast(design), "sampling_stratum").where("__at < __take")
    out = drawn.withColumns({"validation_arm": F.lit("unmatched"), "sampling_design": F.lit("reason_vintage_stratified_hash_srs"), "match_method": F.col("reason")})
    out = with_design(out, F.col("__all"), F.col("__take")).drop("__rank", "__at", "__take", "__all")
    require_no_outcomes(out)
    return out


def validation_sample(judgments: DataFrame, decisions: DataFrame, size: int, unmatched_size: int, seed: int) -> DataFrame:
    """Both arms as one table; text columns that one arm lacks are empty."""
    both = accepted_sample(judgments, decisions, size, seed).unionByName(unmatched_sample(judgments, decisions, unmatched_size, seed), allowMissingColumns=True)
    text = [f.name for f in both.schema.fields if f.dataType.simpleString() == "string"]
    return both.na.fill("", text)
