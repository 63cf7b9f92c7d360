"""Registered queries that run the library's operators on the driver tables, with SQL written for themselves.

The SQL states what the rows must be, in another form than the operators compute them; where a text of
``catalogue`` already does so, it serves as the SQL here. ``orders`` stand for judgments, ``customer`` for companies.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, features, text
from ..operators import adjudication, cohort, disclosure, linkage, metrics, models, release, reports, sampling
from . import catalogue
from .catalogue import DAY, OBSERVED, Duck, Spark

OBSERVED_DAY = dt.date(1998, 9, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows planted by an expression over driver tables."""
    return spark.sql(catalogue.own_views(spark, sf_dir, sql))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


def _age(day: Column) -> Column:
    return dates.days_between(F.lit(OBSERVED_DAY), day)


# Functions

def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, sf_dir, catalogue.companies(Spark))
    last = F.element_at(F.array(*map(F.lit, (" T/A Beta", " trading  as Beta Ltd", ", formerly Beta", " Formerlys"))), (F.col("number") % 4 + 1).cast("int"))
    return rows.select("number", text.normalize_name(F.col("raw_name")).alias("normalized_name"), text.normalize_name(F.concat("raw_name", last)).alias("normalized_alias"))


CODES = {"satisfied": "Satisfied", "unsatisfied": "Unsatisfied", "cancelled": "Cancelled", "canceled": "Cancelled"}
RAW_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN ' Satisfied ' WHEN 1 THEN 'UN-satisfied' WHEN 2 THEN 'unsatisfied.' WHEN 3 THEN 'Canceled' ELSE '& cancelled' END"


def coded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("raw", F.expr(RAW_STATUS))
    return rows.select("o_orderkey", text.decoded(F.col("raw"), CODES).alias("status"))


CODED_SQL = f"""SELECT o_orderkey, CASE trim(regexp_replace(replace(lower(trim({RAW_STATUS})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))
WHEN 'satisfied' THEN 'Satisfied' WHEN 'unsatisfied' THEN 'Unsatisfied' WHEN 'cancelled' THEN 'Cancelled' WHEN 'canceled' THEN 'Cancelled' END AS status FROM orders"""


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "bad").when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit("("), key, F.lit(")"))).when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit(" (£"), key, F.lit(",000.50) "))).when(F.col("o_orderkey") % 7 == 3, " ").otherwise(F.concat(F.lit("£"), key, F.lit(",000")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_amount(raw).alias("amount"), text.amount_is_invalid(raw).alias("invalid"))


def date_parse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "d/M/yyyy")).when(kind == 2, F.date_format(day, "dd-MM-yyyy")).when(kind == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:30:00"))).when(kind == 4, " ").otherwise("31/02/1996")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(raw).alias("day"), dates.date_is_invalid(raw).alias("invalid"))


DATE_SQL = f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN {DAY} END AS day, o_orderkey % 6 = 5 AS invalid FROM orders"


def _banded(rows: DataFrame, band: Column) -> DataFrame:
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def bucket_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(table(spark, sf_dir, "orders"), features.band(F.col("o_totalprice"), *features.AMOUNT_BANDS, missing="amount_missing"))


def bucket_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("shipped")).join(_orders(spark, sf_dir).select("o_orderkey", "day"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _banded(rows, features.band(dates.days_between(F.col("shipped"), F.col("day")), *features.LAG_BANDS))


def bucket_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(_orders(spark, sf_dir), features.right_closed_band(_age(F.col("day")) / F.lit(features.MONTH), *features.AGE_BANDS))


def bucket_age_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _age(F.col("day")) / F.lit(features.REGISTER_MONTH)
    both = F.concat_ws("/", features.band(months, *features.AGE_AUDIT_BANDS), features.right_closed_band(months, *features.STRATUM_BANDS, outside=None))
    return _banded(_orders(spark, sf_dir), both)


AUDIT_AGE_SQL = f"""SELECT band || '/' || stratum AS band, count(*) AS n FROM (SELECT
CASE WHEN m < 1 THEN 'up_to_1_month' WHEN m < 12 THEN 'over_1_to_12_months' WHEN m < 24 THEN 'over_12_to_24_months' WHEN m < 36 THEN 'over_24_to_36_months' WHEN m < 48 THEN 'over_36_to_48_months' WHEN m < 72 THEN 'over_48_to_72_months' ELSE 'over_72_months' END AS band,
CASE WHEN m <= 12 THEN '0' WHEN m <= 24 THEN '1' WHEN m <= 36 THEN '2' ELSE '3' END AS stratum
FROM (SELECT datediff('day', {DAY}, {OBSERVED}) / 30.44 AS m FROM orders) x) y GROUP BY 1"""


def age_basis_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("months", "squared", "cubed", "knot12", "knot24", "knot36")
    basis = features.age_basis(_age(F.col("day"))).values()
    return _orders(spark, sf_dir).select("o_orderkey", *(F.round(v, 9).alias(n) for n, v in zip(names, basis, strict=True)))


def amount_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.amount_features(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(made["log1p_judgment_amount"], 9).alias("log_amount"), made["judgment_amount_missing"].alias("amount_missing"))


def company_age_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _fixture(spark, sf_dir, catalogue.companies(Spark)).select("number", "inc")
    ages = features.company_age(F.col("day"), F.col("inc"))
    rows = _orders(spark, sf_dir).join(made, F.col("o_custkey") == F.col("number"))
    return rows.select("o_orderkey", F.round(ages["company_age_at_judgment_years"], 9).alias("years"), ages["company_age_at_judgment_missing"].cast("long").alias("missing"))


COMPANY_AGE_SQL = f"""SELECT o_orderkey, CASE WHEN d >= 0 THEN round(d / 365.25E0, 9) END AS years, CAST(CASE WHEN d >= 0 THEN 0 ELSE 1 END AS BIGINT) AS missing
FROM (SELECT o_orderkey, datediff('day', inc, {DAY}) AS d FROM orders JOIN ({catalogue.companies(Duck)}) c ON o_custkey = c.number) x"""


def history_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("o_custkey") % 5 > 0, F.lit(dt.date(1995, 3, 31)))
    return _orders(spark, sf_dir).select("o_orderkey", F.round(features.history_coverage(F.col("day"), start), 9).alias("coverage"))


COVERAGE_SQL = f"""SELECT o_orderkey, round(CASE WHEN o_custkey % 5 = 0 THEN 0E0 ELSE least(1E0, greatest(0E0, datediff('day', greatest(low, DATE '1995-03-31'), day) * 1E0 / datediff('day', low, day))) END, 9) AS coverage
FROM (SELECT o_orderkey, o_custkey, {DAY} AS day, CAST({DAY} - INTERVAL 24 MONTH AS DATE) AS low FROM orders) x"""

SNAPSHOT_RAW = "SELECT c_custkey, CASE WHEN c_custkey % 6 > 0 THEN CAST(c_custkey % 6 - 1 AS VARCHAR(20)) ELSE '' END AS charges, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 7 - 1 AS VARCHAR(20)) ELSE 'x' END AS paid, CASE WHEN c_custkey % 4 > 0 THEN CAST(DATE '1998-01-01' + INTERVAL '1' DAY * CAST(c_custkey % 500 AS INT) AS DATE) END AS due, CASE c_custkey % 3 WHEN 0 THEN ' ACTIVE ' WHEN 1 THEN 'Liquidation' END AS status FROM customer"


def snapshot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column comes ready-made but wholly null, so it is derived; another one is taken as it is given."""
    rows = _fixture(spark, sf_dir, SNAPSHOT_RAW)
    named = rows.select("c_custkey", F.col("charges").alias("Mortgages.NumMortCharges"), F.col("paid").alias("Mortgages.NumMortSatisfied"), F.col("due").cast("string").alias("Accounts.NextDueDate"), F.col("status").alias("CompanyStatus"), F.lit(None).cast("double").alias("any_charges"), (F.col("c_custkey") % 2).alias("accounts_overdue"))
    made = cohort.with_snapshot_features(named, F.lit(OBSERVED_DAY))
    return made.select("c_custkey", *(F.round(c, 9).alias(c) for c in cohort.SNAPSHOT_FEATURES))


SNAPSHOT_SQL = f"""SELECT c_custkey, CASE WHEN n IS NOT NULL THEN CASE WHEN n > 0 THEN 1E0 ELSE 0E0 END END AS snapshot_any_charges, n AS snapshot_n_charges,
CASE WHEN n = 0 THEN 0E0 WHEN p IS NOT NULL AND n > 0 THEN round(least(1E0, p / n), 9) END AS snapshot_pct_charges_satisfied, CAST(c_custkey % 2 AS DOUBLE) AS snapshot_accounts_overdue,
CASE WHEN status IS NOT NULL THEN CASE WHEN lower(trim(status)) = 'active' THEN 1E0 ELSE 0E0 END END AS snapshot_company_status_active
FROM (SELECT *, TRY_CAST(charges AS DOUBLE) AS n, TRY_CAST(paid AS DOUBLE) AS p FROM ({SNAPSHOT_RAW}) x) y"""


# Linkage

def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _fixture(spark, sf_dir, catalogue.companies(Spark)).select("number", F.col("raw_name").alias("company_name"), "postcode", F.col("inc").alias("incorporation_date"))
    former = _fixture(spark, sf_dir, catalogue.former_names(Spark)).groupBy("number").agg(F.collect_list(F.struct(F.col("raw").alias("raw_name"), F.col("change").alias("change_date"))).alias("former_names"))
    none = F.array().cast("array<struct<raw_name:string,change_date:date>>")
    return own.join(former, "number", "left").withColumn("former_names", F.coalesce("former_names", none)).withColumn("company_number", F.col("number").cast("string")).drop("number")


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, catalogue.sources(Spark)).select(F.col("id").alias("ID"), F.col("day").alias("JudgmentDate"), F.col("type").alias("DefendantType"), "company_name", "trading_name", "postcode")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.match(_judgments(spark, sf_dir), _companies(spark, sf_dir))


def linkage_unique_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("tier") == "exact_unique", F.concat_ws("|", "matched_on", "matched_name_kind"))
    return _decisions(spark, sf_dir).select(F.col("ID").alias("id"), F.col("matched_company_number").try_cast("long").alias("matched"), place.alias("place"), "postcode_agrees", "reason", F.col("exact_name_candidate_count").alias("candidates"))


def linkage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.shares(_decisions(spark, sf_dir), "reason").select("reason", F.col("rows").alias("n"), F.round("share", 9).alias("share"))


def linkage_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.guard_counts(_decisions(spark, sf_dir)).select("guard", F.col("rows").cast("long").alias("rows"))


GUARDS_SQL = catalogue.linked(Duck) + """SELECT 'candidate_companies_rejected_post_incorporation' AS guard, CAST(sum(rejected) AS BIGINT) AS rows FROM f UNION ALL SELECT 'judgments_with_post_incorporation_rejection', count(*) FROM f WHERE rejected > 0
UNION ALL SELECT 'accepted_matches_missing_incorporation_date', count(*) FROM f WHERE accepted AND missing > 0 UNION ALL SELECT 'judgments_blocked_by_incomplete_name_history', count(*) FROM f WHERE incomplete > 0"""


def linkage_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where("exact_name_candidate_count > 1").select(F.col("ID").alias("id"), F.col("exact_name_candidate_count").alias("candidates"), "rejected_post_incorporation", "incorporation_date_missing", "name_history_incomplete")


AMBIGUOUS_SQL = catalogue.linked(Duck) + "SELECT id, CAST(valid + missing + incomplete AS BIGINT) AS candidates, CAST(rejected AS BIGINT) AS rejected_post_incorporation, missing > 0 AS incorporation_date_missing, incomplete > 0 AS name_history_incomplete FROM f WHERE valid + missing + incomplete > 1"


def _counted(key: str, columns: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = linkage.diagnostics(_judgments(spark, sf_dir).select("ID", "DefendantType", "JudgmentDate"), _decisions(spark, sf_dir))[key]
        return found.select(*(F.expr(e).alias(n) for n, e in columns.items()))

    return run


match_by_type = _counted("by_defendant_type", {"type": "DefendantType", "accepted": "tier = 'exact_unique'", "n": "rows"})
match_by_vintage = _counted("by_judgment_vintage", {"judgment_year": "cast(judgment_year AS BIGINT)", "accepted": "tier = 'exact_unique'", "n": "rows"})
match_coverage = _counted("tier_counts", {"tier": "tier", "n": "rows"})
unmatched_reasons = _counted("unmatched_reasons", {"reason": "reason", "n": "rows", "share": "round(share, 9)"})
match_methods = _counted("method_counts", {"matched_on": "matched_on", "matched_name_kind": "matched_name_kind", "n": "rows"})
UNMATCHED_SQL = catalogue.linked(Duck) + "SELECT reason, count(*) AS n, round(count(*) * 1E0 / sum(count(*)) OVER (), 9) AS share FROM m WHERE matched IS NULL GROUP BY reason"
METHODS_SQL = catalogue.linked(Duck) + "SELECT split_part(place, '|', 1) AS matched_on, split_part(place, '|', 2) AS matched_name_kind, count(*) AS n FROM m WHERE matched IS NOT NULL GROUP BY 1, 2"


def former_name_temporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (judgment, company) of which a name period holds the day."""
    periods = linkage.name_periods(_companies(spark, sf_dir))[0]
    met = linkage.source_names(_judgments(spark, sf_dir)).join(periods, "name")
    day = F.col("JudgmentDate")
    held = met.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))
    return held.select(F.col("ID").alias("id"), F.col("company_number").cast("long").alias("number"), "field", "kind")


def _temporal_sql() -> str:
    d = Duck
    return f"""WITH per AS ({catalogue.name_periods(d, catalogue.former_names(d))}), j AS (SELECT *, {catalogue.name(d, 'company_name')} AS cn, {catalogue.name(d, 'trading_name')} AS tn FROM ({catalogue.sources(d)}) x),
src AS (SELECT id, day, 'company_name' AS field, cn AS n FROM j WHERE cn <> '' UNION ALL SELECT id, day, 'trading_name', tn FROM j WHERE tn <> '')
SELECT id, number, field, kind FROM src JOIN per ON n = normalized_name WHERE (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR day < valid_to)"""


def name_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _fixture(spark, sf_dir, catalogue.companies(Spark)).select(F.col("number").cast("string").alias("company_number"), F.col("raw_name").alias("company_name"), F.col("inc").alias("incorporation_date"))
    changes = _fixture(spark, sf_dir, catalogue.order_names(Spark)).groupBy(F.col("number").cast("string").alias("company_number")).agg(F.collect_list(F.struct(F.col("raw").alias("raw_name"), F.col("change").alias("change_date"))).alias("former_names"))
    none = F.array().cast("array<struct<raw_name:string,change_date:date>>")
    periods = linkage.name_periods(own.join(changes, "company_number", "left").withColumn("former_names", F.coalesce("former_names", none)))[0]
    return periods.select(F.col("company_number").cast("long").alias("number"), F.col("name").alias("normalized_name"), "valid_from", "valid_to", "kind")


def semi_join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = linkage.candidate_companies(_companies(spark, sf_dir), _judgments(spark, sf_dir))
    return wanted.select(F.col("company_number").cast("long").alias("number"), "company_name")


def _candidates_sql() -> str:
    d = Duck
    return f"""WITH j AS (SELECT {catalogue.name(d, 'company_name')} AS a, {catalogue.name(d, 'trading_name')} AS b FROM ({catalogue.sources(d)}) x), wanted AS (SELECT a AS n FROM j UNION SELECT b FROM j),
names AS (SELECT number, {catalogue.name(d, 'raw_name')} AS n FROM ({catalogue.companies(d)}) c UNION SELECT number, {catalogue.name(d, 'raw')} FROM ({catalogue.former_names(d)}) f)
SELECT number, raw_name AS company_name FROM ({catalogue.companies(d)}) c WHERE number IN (SELECT number FROM names WHERE n <> '' AND n IN (SELECT n FROM wanted))"""


# Rules

TYPED = f"""SELECT o_orderkey, {DAY} AS day, CASE o_orderkey % 11 WHEN 0 THEN CAST({DAY} - INTERVAL '1' DAY AS DATE) WHEN 1 THEN NULL ELSE CAST({DAY} + INTERVAL '1' DAY * CAST(o_orderkey % 900 AS INT) AS DATE) END AS satisfied,
CASE o_orderkey % 13 WHEN 0 THEN CAST({DAY} + INTERVAL '1' DAY * CAST(o_orderkey % 700 AS INT) AS DATE) END AS cancelled, CASE WHEN o_orderkey % 3 > 0 THEN CAST({DAY} + INTERVAL '1' DAY * CAST(o_orderkey % 400 AS INT) AS DATE) END AS effective,
CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN DATE '1998-08-31' ELSE DATE '1998-09-01' END AS snapshot, CASE WHEN o_orderkey % 23 = 0 THEN 'reason' ELSE '' END AS why, {catalogue.STATUS} AS status FROM orders"""


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, rows) for every rule on days and status, from one aggregate."""
    from ..sources import register

    rows = _fixture(spark, sf_dir, TYPED).select(F.col("day").alias("JudgmentDate"), F.col("satisfied").alias("Satisfaction Date"), F.col("cancelled").alias("Cancellation Date"), F.col("effective").alias("Status Effective Date"), F.col("snapshot").alias("Snapshot Date"), F.col("why").alias("Cancellation Reason"), F.col("status").alias("JudgmentStatus"))
    rules = {"JudgmentDate after the observation": F.col("JudgmentDate") > F.lit(OBSERVED_DAY)} | register.timing_rules(set(register.OPTIONAL), OBSERVED_DAY)
    sums = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())))
    return sums.select(F.expr(f"stack({len(rules)}, {', '.join(f"'{n}', r{i}" for i, n in enumerate(rules))}) AS (rule, rows)"))


def _violations_sql() -> str:
    o = OBSERVED
    rules = {"JudgmentDate after the observation": f"day > {o}"}
    for name, c in (("Satisfaction Date", "satisfied"), ("Cancellation Date", "cancelled"), ("Status Effective Date", "effective"), ("Snapshot Date", "snapshot")):
        rules |= {f"{name} before JudgmentDate": f"{c} < day", f"{name} after the observation": f"{c} > {o}"}
    rules |= {"Satisfied without Satisfaction Date": "status = 'Satisfied' AND satisfied IS NULL", "Unsatisfied with Satisfaction Date": "status = 'Unsatisfied' AND satisfied IS NOT NULL", "Cancelled without Cancellation Date": "status = 'Cancelled' AND cancelled IS NULL", "Cancellation Date on another status": "status <> 'Cancelled' AND cancelled IS NOT NULL", "Cancellation Reason on another status": "status <> 'Cancelled' AND why <> ''", "Cancellation Date before Satisfaction Date": "cancelled < satisfied", "Status Effective Date before its event": "(status = 'Satisfied' AND effective < satisfied) OR (status = 'Cancelled' AND effective < cancelled)", "Snapshot Date is missing": "snapshot IS NULL", "Snapshot Date is not the observation": f"snapshot <> {o}"}
    return f"WITH t AS ({TYPED}) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS rows FROM t" for n, c in rules.items())


# Samples and estimates

def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stratum"), sampling.rank_digest(20260618, "accepted", F.col("o_orderkey"), F.col("o_custkey").cast("string")).alias("rank_digest"))
    return sampling.systematic(rows, 1000, "stratum", "rank_digest", "id", 20260618, "accepted").select("id", "stratum", "rank_digest")


def _systematic_sql(count: int = 1000) -> str:
    start = sampling.start_fraction(20260618, "accepted")
    return f"""WITH x AS (SELECT o_orderkey AS id, o_orderpriority AS stratum, sha256('20260618|accepted|' || o_orderkey || '|' || o_custkey) AS rank_digest FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY stratum, rank_digest, id) - 1 AS place, count(*) OVER () AS total FROM x)
SELECT id, stratum, rank_digest FROM p WHERE total <= {count} OR place IN (SELECT CAST(floor(({start!r}E0 + i) * ((SELECT count(*) FROM x) * 1E0 / {count})) AS BIGINT) FROM range({count}) t(i))"""


def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of each reason and year by hashed rank, positions from digest buckets."""
    from ..operators.order import digest_bucket, with_position

    stratum = F.concat(F.lit("reason="), F.col("o_orderstatus"), F.lit("|judgment_year="), F.year("day").cast("string"))
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), stratum.alias("stratum"))
    ranked = rows.withColumn("rank_digest", sampling.rank_digest(20260618, F.concat(F.lit("unmatched|"), F.col("stratum")), F.col("id")))
    return with_position(ranked, ["stratum"], digest_bucket(F.col("rank_digest")), [F.col("rank_digest"), F.col("id")], "at").where("at < 10").select("stratum", "id", "rank_digest")


def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = _judgments(spark, sf_dir)
    return sampling.validation_sample(js.select(F.col("ID").cast("string"), "JudgmentDate"), _decisions(spark, sf_dir).withColumn("ID", F.col("ID").cast("string")), 1000, 400, 20260618)


REVIEWED = """SELECT CAST(l.doc_id AS VARCHAR(20)) AS id, CASE WHEN l.doc_id % 2 = 0 THEN ' Accepted' ELSE 'unmatched' END AS arm, CASE WHEN l.doc_id % 2 = 0 THEN 'tier=exact_unique' ELSE concat('reason=', d.lang) END AS stratum, l.toxic AS toxic, l.doc_id AS doc_id
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
_LABEL = lambda expr: f"CASE WHEN doc_id % 2 = 0 THEN CASE WHEN {expr} = 1 THEN 'incorrect_match' ELSE 'Correct_Match' END ELSE CASE WHEN {expr} = 1 THEN 'missed_match' ELSE 'true_unmatched' END END"
_SECOND = "CASE WHEN doc_id % 9 = 0 THEN 1 - toxic ELSE toxic END"
_NUMBER = "CASE WHEN doc_id % 2 = 1 AND {t} = 1 THEN concat('m ', CAST(doc_id AS VARCHAR(20))) ELSE '' END"
AUDITED = f"""SELECT id AS "ID", arm AS validation_arm, stratum AS sampling_stratum, 2 * count(*) OVER (PARTITION BY stratum) AS stratum_population_n, count(*) OVER (PARTITION BY stratum) AS stratum_sample_n,
0.5E0 AS inclusion_probability, 2E0 AS sampling_weight, CASE WHEN doc_id % 2 = 0 THEN concat('C', id) ELSE '' END AS matched_company_number, {_LABEL('toxic')} AS reviewer_1_label, {_NUMBER.format(t='toxic')} AS reviewer_1_company_number,
{_LABEL(_SECOND)} AS reviewer_2_label, {_NUMBER.format(t=_SECOND)} AS reviewer_2_company_number, {_LABEL('toxic')} AS adjudicated_label, {_NUMBER.format(t='toxic')} AS adjudicated_company_number, '' AS adjudication_notes, doc_id FROM ({REVIEWED}) r"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, AUDITED.replace('"ID"', "ID"))


def adjudication_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken rule of each row of a table with planted faults."""
    rows = _audited(spark, sf_dir)
    bad = {"reviewer_1_label": F.when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("reviewer_1_label")), "reviewer_2_company_number": F.when(F.col("doc_id") % 10 == 3, "x1").otherwise(F.col("reviewer_2_company_number")), "matched_company_number": F.when(F.col("doc_id") % 10 == 4, "").otherwise(F.col("matched_company_number")), "adjudicated_label": F.when(F.col("doc_id") % 10 == 6, "incorrect_match").otherwise(F.col("adjudicated_label"))}
    return adjudication.violation(adjudication.cleaned(rows.withColumns(bad))).select("doc_id", "violation")


VIOLATIONS_SQL = f"""WITH t AS (SELECT doc_id, doc_id % 10 AS k, toxic AS y, {_SECOND} AS z FROM ({REVIEWED}) r)
SELECT doc_id, CASE WHEN k = 1 THEN 'reviewer_1_label is blank'
WHEN k = 6 AND y = 0 AND z = 0 THEN 'adjudicated_label differs from agreeing reviewers'
WHEN k = 4 AND y = 0 THEN 'no matched company number'
WHEN k = 4 AND z = 0 THEN 'no matched company number'
WHEN k = 3 AND z = 0 THEN 'reviewer_2_company_number must be blank'
WHEN k = 3 AND y = 1 AND z = 1 THEN NULL END AS violation FROM t"""


def stratum_metadata_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design columns of each stratum, and what is wrong with those in which faults are planted."""
    rows = adjudication.cleaned(_audited(spark, sf_dir))
    planted = rows.withColumn("sampling_weight", F.when(F.col("sampling_stratum") == "reason=de", 3.0).when((F.col("sampling_stratum") == "reason=fr") & (F.col("doc_id") % 5 == 0), 4.0).otherwise(F.col("sampling_weight")))
    return adjudication.stratum_faults(planted).select(F.col("sampling_stratum").alias("stratum"), "rows", F.col("stratum_population_n").cast("long").alias("population_n"), "fault")


STRATA_SQL = f"""SELECT stratum, count(*) AS rows, CAST(2 * count(*) AS BIGINT) AS population_n, CASE WHEN stratum = 'reason=fr' AND count(*) FILTER (WHERE doc_id % 5 = 0) BETWEEN 1 AND count(*) - 1 THEN 'sampling_weight is not one number' WHEN stratum IN ('reason=de', 'reason=fr') AND (stratum = 'reason=de' OR count(*) FILTER (WHERE doc_id % 5 = 0) = count(*)) THEN 'sampling_weight is not population by sample' END AS fault FROM ({REVIEWED}) r GROUP BY stratum"""


def wilson_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    low, high = adjudication.wilson(F.col("k"), F.col("n"), 1.959963984540054)
    return counts.select("quality", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def weighted_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudication.weighted_prevalence(adjudication.strata(adjudication.cleaned(_audited(spark, sf_dir))), 0.95)
    return found.select("validation_arm", *(F.round(c, 9).alias(c) for c in ("estimate", "lower_ci", "upper_ci", "estimated_positive_total")), "population_n", "sample_n")


def _prevalence_sql(confidence: float = 0.95, tail: str = "") -> str:
    from statistics import NormalDist

    z = {n: NormalDist().inv_cdf(1 - (1 - confidence) / n / 2) for n in range(1, 9)}
    cases = " ".join(f"WHEN {n} THEN {v!r}E0" for n, v in z.items())
    final = tail or "SELECT arm AS validation_arm, round(e, 9) AS estimate, round(lo, 9) AS lower_ci, round(hi, 9) AS upper_ci, round(pos, 9) AS estimated_positive_total, pop AS population_n, CAST(smp AS BIGINT) AS sample_n FROM a"
    return f"""WITH s AS (SELECT lower(trim(arm)) AS arm, stratum, count(*) AS n, 2 * count(*) AS big, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 - toxic ELSE toxic END) AS BIGINT) AS k FROM ({REVIEWED}) r GROUP BY 1, 2),
w AS (SELECT *, k * 1E0 / n AS p, CASE count(*) OVER (PARTITION BY arm) {cases} END AS z FROM s),
i AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS c, z * sqrt(p * (1 - p) / n + z * z / (4E0 * n * n)) / (1 + z * z / n) AS r FROM w),
a AS (SELECT arm, sum(big * p) / sum(big) AS e, sum(big * greatest(0, c - r)) / sum(big) AS lo, sum(big * least(1, c + r)) / sum(big) AS hi, sum(big * p) AS pos, CAST(sum(big) AS BIGINT) AS pop, sum(n) AS smp FROM i GROUP BY arm)
{final}"""


def linkage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudication.summary(_audited(spark, sf_dir).drop("doc_id"), recall_supported=True)["estimates"]
    return found.where("measure = 'linkage_recall'").select("measure", *(F.round(c, 9).alias(c) for c in ("estimate", "lower_ci", "upper_ci")), "population_n", "status")


RECALL_SQL = _prevalence_sql(0.975, "SELECT 'linkage_recall' AS measure, round(sum(pos) / sum(pos), 9) * 0 + round(max(CASE WHEN arm = 'accepted' THEN pos END) / sum(pos), 9) AS estimate, round(max(CASE WHEN arm = 'accepted' THEN lo * pop END) / (max(CASE WHEN arm = 'accepted' THEN lo * pop END) + max(CASE WHEN arm = 'unmatched' THEN hi * pop END)), 9) AS lower_ci, round(max(CASE WHEN arm = 'accepted' THEN hi * pop END) / (max(CASE WHEN arm = 'accepted' THEN hi * pop END) + max(CASE WHEN arm = 'unmatched' THEN lo * pop END)), 9) AS upper_ci, CAST(sum(pop) AS BIGINT) AS population_n, 'estimated' AS status FROM a").replace("round(sum(pos) / sum(pos), 9) * 0 + ", "")


def reviewer_agreement_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudication.reviewer_agreement(adjudication.cleaned(_audited(spark, sf_dir)))
    return found.select("validation_arm", "reviewed_n", *(F.round(c, 9).alias(c) for c in ("label_agreement", "decision_agreement", "cohen_kappa")))


KAPPA_SQL = f"""WITH t AS (SELECT lower(trim(arm)) AS arm, CASE WHEN doc_id % 2 = 0 THEN 1 - toxic ELSE toxic END AS a, CASE WHEN doc_id % 2 = 0 THEN 1 - ({_SECOND}) ELSE {_SECOND} END AS b FROM ({REVIEWED}) r), u AS (SELECT * FROM t UNION ALL SELECT 'overall', a, b FROM t),
g AS (SELECT arm, count(*) AS n, avg(CASE WHEN a = b THEN 1E0 ELSE 0E0 END) AS o, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS e FROM u GROUP BY arm)
SELECT arm AS validation_arm, n AS reviewed_n, round(o, 9) AS label_agreement, round(o, 9) AS decision_agreement, CASE WHEN abs(1 - e) > 1E-9 THEN round((o - e) / (1 - e), 9) END AS cohen_kappa FROM g"""


# Cohort

def _cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Satisfied").when(F.col("o_orderstatus") == "O", "Unsatisfied").otherwise("Cancelled")
    kind = F.when(F.col("o_orderkey") % 4 < 3, " Corporate").otherwise("Consumer")
    where = F.when(F.col("o_orderkey") % 5 < 4, "ENGLAND AND WALES").otherwise("Scotland")
    tier = F.when(F.col("o_custkey") % 3 > 0, "exact_unique").otherwise("unmatched")
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("ID"), F.col("day").alias("JudgmentDate"), status.alias("JudgmentStatus"), kind.alias("DefendantType"), where.alias("Jurisdiction"), tier.alias("tier"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).otherwise("").alias("matched_company_number"), F.col("o_totalprice").alias("Amount"))


_BASE = f"""SELECT o_orderkey AS id, o_custkey AS c, {DAY} AS day, o_orderkey % 4 < 3 AS corp, o_orderkey % 5 < 4 AS ew, o_orderstatus IN ('F', 'O') AS lab, o_orderstatus = 'F' AS sat, o_custkey % 3 > 0 AS exact, o_totalprice AS amount,
{DAY} >= CAST({OBSERVED} - INTERVAL 48 MONTH AS DATE) AND {DAY} < CAST({OBSERVED} - INTERVAL 1 MONTH AS DATE) AS aged FROM orders"""


def cohort_filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.funnel(_cohort_rows(spark, sf_dir), cohort.conditions(F.lit(OBSERVED_DAY)))


FUNNEL_SQL = f"""SELECT count(*) AS judgments_read, count(day) AS valid_judgment_date, count(*) FILTER (WHERE corp) AS corporate, count(*) FILTER (WHERE corp AND ew) AS england_and_wales_corporate, count(*) FILTER (WHERE corp AND ew AND lab) AS satisfied_or_unsatisfied_corporate_ew,
count(*) FILTER (WHERE corp AND ew AND lab AND aged) AS primary_age_window_corporate_ew_labelled, count(*) FILTER (WHERE corp AND ew AND lab AND aged AND exact) AS exact_unique_matched_eligible_judgments, count(*) FILTER (WHERE corp AND ew AND lab AND aged AND exact) AS eligible_judgments,
count(DISTINCT c) FILTER (WHERE corp AND ew AND lab AND aged AND exact) AS eligible_unique_companies, count(*) FILTER (WHERE corp AND ew AND lab AND aged AND exact) - count(DISTINCT c) FILTER (WHERE corp AND ew AND lab AND aged AND exact) AS eligible_repeat_judgments FROM ({_BASE}) x"""


def model_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cohort: filters, features, history, splits and masked labels."""
    rows = _cohort_rows(spark, sf_dir)
    inc = _fixture(spark, sf_dir, catalogue.companies(Spark)).select(F.col("number").cast("string").alias("matched_company_number"), F.coalesce("inc", F.lit(dt.date(1991, 5, 5))).alias("IncorporationDate"))
    judgments = rows.drop("tier", "matched_company_number")
    decisions = rows.select("ID", "tier", "matched_company_number").join(inc, "matched_company_number", "left")
    frame = cohort.prepare(judgments, decisions, OBSERVED_DAY).frame
    return frame.select("ID", "split", F.col("label").cast("long").alias("label"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("observation_age_months", "company_age_at_judgment_years", "log1p_judgment_amount", "observable_retained_prior_judgment_count_24m", "days_since_observable_retained_prior_judgment_24m", "observable_retained_history_calendar_coverage_24m")))


COHORT_SQL = f"""WITH b AS ({_BASE}), h AS (SELECT * FROM b WHERE corp AND ew AND exact), e AS (SELECT * FROM h WHERE lab AND aged),
inc AS (SELECT number, coalesce(inc, DATE '1991-05-05') AS inc FROM ({catalogue.companies(Duck)}) k),
p AS (SELECT e.id, count(h.id) AS n, max(h.day) AS last FROM e LEFT JOIN h ON h.c = e.c AND h.day < e.day AND h.day >= CAST(e.day - INTERVAL 24 MONTH AS DATE) GROUP BY e.id),
a AS (SELECT c, quantile_cont(datediff('day', day, {OBSERVED}) / (365.25E0 / 12), 0.5) AS age, sha256('20260619' || chr(0) || c) AS digest FROM e GROUP BY c),
r AS (SELECT c, s, row_number() OVER (PARTITION BY s ORDER BY digest, c) - 1 AS at, count(*) OVER (PARTITION BY s) AS n FROM (SELECT c, digest, CASE WHEN age <= 12 THEN 0 WHEN age <= 24 THEN 1 WHEN age <= 36 THEN 2 ELSE 3 END AS s FROM a) q),
f AS (SELECT DISTINCT s, n, k, share, share * n - floor(share * n) AS rest, floor(share * n) AS base FROM r CROSS JOIN (VALUES (0, 0.6E0), (1, 0.15E0), (2, 0.1E0), (3, 0.15E0)) v(k, share)),
g AS (SELECT s, k, base + CASE WHEN row_number() OVER (PARTITION BY s ORDER BY rest DESC, k) <= n - sum(base) OVER (PARTITION BY s) THEN 1 ELSE 0 END AS size FROM f),
u AS (SELECT s, k, sum(size) OVER (PARTITION BY s ORDER BY k) AS upto FROM g),
t AS (SELECT c, CASE (SELECT min(k) FROM u WHERE u.s = r.s AND r.at < u.upto) WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'calibration' ELSE 'test' END AS split FROM r)
SELECT e.id AS "ID", t.split, CASE WHEN t.split <> 'test' THEN CAST(e.sat AS BIGINT) END AS label, round(datediff('day', e.day, {OBSERVED}) / (365.25E0 / 12), 6) AS observation_age_months,
CASE WHEN e.day >= inc.inc THEN round(datediff('day', inc.inc, e.day) / 365.25E0, 6) END AS company_age_at_judgment_years, round(ln(1 + e.amount), 6) AS log1p_judgment_amount, CAST(p.n AS DOUBLE) AS observable_retained_prior_judgment_count_24m,
CAST(datediff('day', p.last, e.day) AS DOUBLE) AS days_since_observable_retained_prior_judgment_24m,
round(least(1E0, greatest(0E0, datediff('day', greatest(CAST(e.day - INTERVAL 24 MONTH AS DATE), (SELECT min(day) FROM h)), e.day) * 1E0 / datediff('day', CAST(e.day - INTERVAL 24 MONTH AS DATE), e.day))), 6) AS observable_retained_history_calendar_coverage_24m
FROM e JOIN t ON e.c = t.c JOIN inc ON e.c = inc.number JOIN p ON e.id = p.id"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.with_prior_history(_orders(spark, sf_dir), "o_custkey", "day", "o_totalprice")


def prior_history_24m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("o_orderkey", F.col(cohort.HISTORY_FEATURES[0]).alias("prior_n"), F.round(cohort.HISTORY_FEATURES[1], 2).alias("prior_value"))


def days_since_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("o_orderkey", F.col(cohort.HISTORY_FEATURES[2]).cast("long").alias("days_since"))


HISTORY_SQL = f"""WITH o AS (SELECT o_orderkey, o_custkey, {DAY} AS day, o_totalprice AS v FROM orders)
SELECT a.o_orderkey, count(b.o_orderkey) AS prior_n, round(coalesce(sum(b.v), 0), 2) AS prior_value FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day < a.day AND b.day >= CAST(a.day - INTERVAL 24 MONTH AS DATE) GROUP BY a.o_orderkey"""
SINCE_SQL = f"""WITH o AS (SELECT o_orderkey, o_custkey, {DAY} AS day FROM orders)
SELECT a.o_orderkey, CAST(min(datediff('day', b.day, a.day)) AS BIGINT) AS days_since FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day < a.day AND b.day >= CAST(a.day - INTERVAL 24 MONTH AS DATE) GROUP BY a.o_orderkey"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").cast("string").alias("company"), (_age(F.col("day")) / F.lit(features.MONTH)).alias("age"))
    return cohort.with_company_splits(rows, "company", "age")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select(F.col("company").cast("long").alias("o_custkey"), "split").distinct()


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.split_counts(_split(spark, sf_dir), "company", "age").select("split", "rows", "unique_companies", F.round("mean_observation_age_months", 6).alias("mean_age"))


def _split_counts_sql() -> str:
    return f"""SELECT s.split, count(*) AS rows, count(DISTINCT o.o_custkey) AS unique_companies, round(avg(datediff('day', {DAY}, {OBSERVED}) / (365.25E0 / 12)), 6) AS mean_age FROM orders o JOIN ({catalogue.group_split(Duck)}) s ON o.o_custkey = s.o_custkey GROUP BY s.split"""


def split_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard on a table where some companies cross splits and some rows have an unknown one."""
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("company"), F.when(F.col("o_orderkey") % 101 == 0, "other").when(F.col("o_custkey") % 50 == 0, F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("test")).otherwise("train").alias("split"))
    return cohort.split_faults(rows, "company")


SPLIT_GUARD_SQL = """WITH s AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 101 = 0 THEN 'other' WHEN o_custkey % 50 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END ELSE 'train' END AS split FROM orders)
SELECT (SELECT count(*) FROM (SELECT c FROM s GROUP BY c HAVING count(DISTINCT split) > 1) x) AS crossing_companies, (SELECT count(*) FROM s WHERE split = 'other') AS unknown_rows"""


def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a company: its first order's day, split without dividing a day."""
    first = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("matched_company_number")).agg(F.min("day").alias("JudgmentDate"))
    return cohort.with_chronological_splits(first).select("matched_company_number", "split")


CHRONO_SQL = f"""WITH f AS (SELECT o_custkey AS c, min({DAY}) AS day FROM orders GROUP BY 1), d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, sum(count(*)) OVER (ORDER BY day) AS s FROM f GROUP BY day),
t AS (SELECT (SELECT count(*) FROM f) * 1E0 AS n, (SELECT max(k) FROM d) AS m),
b1 AS (SELECT k FROM d, t WHERE k <= m - 3 ORDER BY abs(s - n * 0.6E0), k LIMIT 1),
b2 AS (SELECT k FROM d, t WHERE k > (SELECT k FROM b1) AND k <= m - 2 ORDER BY abs(s - n * 0.75E0), k LIMIT 1),
b3 AS (SELECT k FROM d, t WHERE k > (SELECT k FROM b2) AND k <= m - 1 ORDER BY abs(s - n * 0.85E0), k LIMIT 1)
SELECT c AS matched_company_number, CASE WHEN k <= (SELECT k FROM b1) THEN 'train' WHEN k <= (SELECT k FROM b2) THEN 'validation' WHEN k <= (SELECT k FROM b3) THEN 'calibration' ELSE 'test' END AS split FROM f JOIN d ON f.day = d.day"""


def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the split itself: those of the test companies are null."""
    rows = _orders(spark, sf_dir).join(_split(spark, sf_dir).select("o_orderkey", "split"), "o_orderkey")
    return rows.select("o_orderkey", cohort.masked_label(F.col("split"), F.when(F.col("o_orderstatus") == "F", "Satisfied").otherwise("Unsatisfied")).alias("label"))


def _mask_sql() -> str:
    return f"SELECT o_orderkey, CASE WHEN s.split <> 'test' THEN CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END AS label FROM orders o JOIN ({catalogue.group_split(Duck)}) s ON o.o_custkey = s.o_custkey"


# Reports

def audit_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cohort_rows(spark, sf_dir)
    made = reports.audit_counts(rows.select("JudgmentStatus", F.trim("DefendantType").alias("DefendantType"), "Jurisdiction", "JudgmentDate", "Amount").withColumns({"age_at_observation_months": _age(F.col("JudgmentDate")) / F.lit(features.REGISTER_MONTH), "registration_lag_days": F.lit(None).cast("int")}))
    return made.select("dimension", "value", "rows", F.round("share", 9).alias("share"))


AUDIT_SQL = f"""WITH b AS (SELECT CASE WHEN sat THEN 'Satisfied' WHEN lab THEN 'Unsatisfied' ELSE 'Cancelled' END AS s, CASE WHEN corp THEN 'Corporate' ELSE 'Consumer' END AS t, CASE WHEN ew THEN 'ENGLAND AND WALES' ELSE 'Scotland' END AS j, CAST(extract(YEAR FROM day) AS VARCHAR) AS y,
CASE WHEN amount < 500 THEN 'under_500' WHEN amount < 1000 THEN '500_999' WHEN amount < 5000 THEN '1000_4999' WHEN amount < 25000 THEN '5000_24999' ELSE '25000_plus' END AS a, datediff('day', day, {OBSERVED}) / 30.44 AS m FROM ({_BASE}) x),
l AS (SELECT 'JudgmentStatus' AS dimension, s AS value FROM b UNION ALL SELECT 'DefendantType', t FROM b UNION ALL SELECT 'Jurisdiction', j FROM b UNION ALL SELECT 'judgment_year', y FROM b UNION ALL SELECT 'amount_band', a FROM b UNION ALL SELECT 'registration_lag_band', 'missing' FROM b
UNION ALL SELECT 'observation_age_band', CASE WHEN m < 1 THEN 'up_to_1_month' WHEN m < 12 THEN 'over_1_to_12_months' WHEN m < 24 THEN 'over_12_to_24_months' WHEN m < 36 THEN 'over_24_to_36_months' WHEN m < 48 THEN 'over_36_to_48_months' WHEN m < 72 THEN 'over_48_to_72_months' ELSE 'over_72_months' END FROM b
UNION ALL SELECT 'status_x_type_x_jurisdiction_x_vintage', s || ' | ' || t || ' | ' || j || ' | ' || y FROM b
UNION ALL SELECT 'input_column', v FROM b, (VALUES ('JudgmentStatus'), ('DefendantType'), ('Jurisdiction'), ('JudgmentDate'), ('Amount')) w(v))
SELECT dimension, value, count(*) AS rows, round(count(*) * 1E0 / (SELECT count(*) FROM b), 9) AS share FROM l GROUP BY 1, 2"""


def population_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cohort_rows(spark, sf_dir).withColumns({"DefendantType": F.trim("DefendantType"), "Jurisdiction": F.when(F.col("Jurisdiction") == "Scotland", "Scotland").otherwise("England and Wales")})
    found = reports.population_comparison(rows, rows, OBSERVED_DAY)
    return found.select("analysis", "stratum", "rows", "unique_companies", "positive", "negative", F.round("recorded_satisfied_rate", 9).alias("rate"))


POPULATION_SQL = f"""WITH b AS ({_BASE}), l AS (SELECT 'population' AS analysis, 'all_corporate_england_wales_register_stock' AS stratum, * FROM b WHERE corp AND ew
UNION ALL SELECT 'population', 'binary_status_corporate_england_wales', * FROM b WHERE corp AND ew AND lab UNION ALL SELECT 'population', 'post_one_to_48_month_binary_status', * FROM b WHERE corp AND ew AND lab AND aged
UNION ALL SELECT 'population', 'included_unique_exact_live_company', * FROM b WHERE corp AND ew AND lab AND aged AND exact UNION ALL SELECT 'population', 'excluded_unmatched_live_company_bulk', * FROM b WHERE corp AND ew AND lab AND aged AND NOT exact
UNION ALL SELECT 'linkage_selection', CASE WHEN exact THEN 'match_tier_exact_unique' ELSE 'match_tier_unmatched' END, * FROM b WHERE corp AND ew AND lab AND aged
UNION ALL SELECT 'judgment_year', CAST(extract(YEAR FROM day) AS VARCHAR), * FROM b WHERE corp AND ew AND lab AND aged AND exact
UNION ALL SELECT 'amount_band', CASE WHEN amount < 500 THEN 'under_500' WHEN amount < 1000 THEN '500_999' WHEN amount < 5000 THEN '1000_4999' WHEN amount < 25000 THEN '5000_24999' ELSE '25000_plus' END, * FROM b WHERE corp AND ew AND lab AND aged AND exact
UNION ALL SELECT 'age_band', CASE WHEN m > 1 AND m <= 12 THEN 'over_1_to_12' WHEN m > 12 AND m <= 24 THEN 'over_12_to_24' WHEN m > 24 AND m <= 36 THEN 'over_24_to_36' WHEN m > 36 AND m <= 48 THEN 'over_36_to_48' ELSE 'outside_or_missing' END, id, c, day, corp, ew, lab, sat, exact, amount, aged FROM (SELECT *, datediff('day', day, {OBSERVED}) / (365.25E0 / 12) AS m FROM b WHERE corp AND ew AND lab AND aged AND exact) q)
SELECT analysis, stratum, count(*) AS rows, count(DISTINCT CASE WHEN exact THEN c END) AS unique_companies, count(*) FILTER (WHERE sat) AS positive, count(*) FILTER (WHERE lab AND NOT sat) AS negative, CASE WHEN count(*) FILTER (WHERE lab) > 0 THEN round(count(*) FILTER (WHERE sat) * 1E0 / count(*) FILTER (WHERE lab), 9) END AS rate FROM l GROUP BY 1, 2"""


def small_cell_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return disclosure.suppress_small_cells(counts, ["n", "p"], 3)


SUPPRESS_SQL = "SELECT * FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1) x WHERE n NOT IN (1, 2) AND p NOT IN (1, 2)"


def matching_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _decisions(spark, sf_dir)
    return linkage.matching_funnel(_judgments(spark, sf_dir), made, made.where("tier = 'exact_unique' AND ID % 10 = 0"), made.where("tier = 'unmatched' AND ID % 10 = 0"))


MATCH_FUNNEL_SQL = catalogue.linked(Duck) + """SELECT 'judgments_read' AS stage, count(*) AS rows FROM m UNION ALL SELECT 'matching_decisions', count(*) FROM m UNION ALL SELECT 'unique_exact_name', count(matched) FROM m UNION ALL SELECT 'unmatched', count(*) - count(matched) FROM m
UNION ALL SELECT 'accepted_validation_sample', count(matched) FROM m WHERE id % 10 = 0 UNION ALL SELECT 'unmatched_validation_sample', count(*) - count(matched) FROM m WHERE id % 10 = 0"""


def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.content_fingerprint(table(spark, sf_dir, "orders"))


# Metrics and models

def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda k: ((F.col("doc_id") * k) % 100 + 0.5) / 100
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 37).alias("cluster"), F.col("toxic").alias("y"), p(37).alias("p"), p(61).alias("q"))


def auc_brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.evaluate(_scored(spark, sf_dir))
    return found.select(F.round("roc_auc", 9).alias("auc"), F.round("brier", 9).alias("brier"), F.round("log_loss", 9).alias("log_loss"))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(_scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("ap"))


def null_model_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.evaluate(_scored(spark, sf_dir), training_prevalence=0.2)
    return found.select("n", "n_positive", "n_negative", *(F.round(c, 9).alias(c) for c in ("base_rate", "mean_prediction", "calibration_gap", "brier_improvement_vs_null", "log_loss_improvement_vs_null")))


GAIN_SQL = catalogue.scored(Duck) + """SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, CAST(sum(1 - y) AS BIGINT) AS n_negative, round(avg(y), 9) AS base_rate, round(avg(p), 9) AS mean_prediction, round(abs(avg(p) - avg(y)), 9) AS calibration_gap,
round(avg((0.2E0 - y) * (0.2E0 - y)) - avg((p - y) * (p - y)), 9) AS brier_improvement_vs_null, round(avg(y * ln(p) + (1 - y) * ln(1 - p)) - avg(y * ln(0.2E0) + (1 - y) * ln(0.8E0)), 9) AS log_loss_improvement_vs_null FROM s"""


def capacity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.capacity(_scored(spark, sf_dir))
    return found.select("fraction", F.col("selected").alias("k"), F.col("selected_positive").alias("hits"), F.round("positive_rate", 9).alias("rate"), F.round("lift", 9).alias("lift"), F.round("recall", 9).alias("recall"))


def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(_scored(spark, sf_dir)).select("bin", F.col("rows").alias("n"), F.round("mean_prediction", 9).alias("mean_p"), F.round("observed_rate", 9).alias("rate"))


REPLICATES = 20


def _draws_sql() -> str:
    return f"""s AS (SELECT doc_id, doc_id % 37 AS c, toxic AS y, CAST((doc_id * 37) % 100 + 0.5 AS DOUBLE) / 100 AS p, CAST((doc_id * 61) % 100 + 0.5 AS DOUBLE) / 100 AS q FROM labels),
k AS (SELECT c, row_number() OVER (ORDER BY sha256('7|cluster|' || c), c) - 1 AS at, count(*) OVER () AS m FROM (SELECT DISTINCT c FROM s) x),
d AS (SELECT r, CAST(('0x' || substr(sha256('7|' || r || '|' || j), 1, 12)) AS BIGINT) % (SELECT max(m) FROM k) AS at FROM range({REPLICATES}) a(r), range((SELECT max(m) FROM k)) b(j)),
w AS (SELECT r, c, count(*) AS w FROM d JOIN k ON d.at = k.at GROUP BY 1, 2),
x AS (SELECT r, y, p, q, w FROM s JOIN w ON s.c = w.c)"""


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.bootstrap(_scored(spark, sf_dir), REPLICATES, 7, fractions=())
    return found.select("metric", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


def _replicates_sql(p: str) -> str:
    return f"""SELECT r, sum(CASE WHEN y = 1 THEN n * (below + same / 2) ELSE 0 END) / (max(pos) * (max(tot) - max(pos))) AS roc_auc, sum(n * ({p} - y) * ({p} - y)) / max(tot) AS brier, -sum(n * (y * ln({p}) + (1 - y) * ln(1 - {p}))) / max(tot) AS log_loss, abs(sum(n * {p}) / max(tot) - max(pos) / max(tot)) AS calibration_gap,
sum(CASE WHEN y = 1 THEN n * tp / alln ELSE 0 END) / max(pos) AS average_precision FROM
(SELECT *, sum(CASE WHEN y = 0 THEN n ELSE 0 END) OVER (PARTITION BY r ORDER BY {p}) - sum(CASE WHEN y = 0 THEN n ELSE 0 END) OVER (PARTITION BY r, {p}) AS below, sum(CASE WHEN y = 0 THEN n ELSE 0 END) OVER (PARTITION BY r, {p}) AS same, sum(CASE WHEN y = 1 THEN n ELSE 0 END) OVER (PARTITION BY r ORDER BY {p} DESC) AS tp, sum(n) OVER (PARTITION BY r ORDER BY {p} DESC) AS alln,
sum(n * y) OVER (PARTITION BY r) AS pos, sum(n) OVER (PARTITION BY r) AS tot FROM (SELECT r, y, {p}, CAST(sum(w) AS DOUBLE) AS n FROM x GROUP BY 1, 2, 3) t) v GROUP BY r HAVING max(pos) > 0 AND max(pos) < max(tot)"""


def _bootstrap_sql() -> str:
    names = ("roc_auc", "average_precision", "brier", "log_loss", "calibration_gap")
    return f"WITH {_draws_sql()}, z AS ({_replicates_sql('p')}) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(quantile_cont({n}, 0.025), 9) AS lower, round(quantile_cont({n}, 0.975), 9) AS upper FROM z" for n in names)


def paired_bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.paired_bootstrap(_scored(spark, sf_dir), "p", "q", REPLICATES, 7, fractions=())
    return found.select("metric", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


def _paired_sql() -> str:
    gains = {"delta_roc_auc": "a.roc_auc - b.roc_auc", "delta_average_precision": "a.average_precision - b.average_precision", "brier_improvement_vs_age_only": "b.brier - a.brier", "log_loss_improvement_vs_age_only": "b.log_loss - a.log_loss"}
    return f"WITH {_draws_sql()}, a AS ({_replicates_sql('p')}), b AS ({_replicates_sql('q')}) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(quantile_cont({e}, 0.025), 9) AS lower, round(quantile_cont({e}, 0.975), 9) AS upper FROM a JOIN b ON a.r = b.r" for n, e in gains.items())


def impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")).alias("v"), F.lit(None).cast("double").alias("none"), F.lit(2.5).alias("same"))
    made = models.prepare(rows, ("v", "none", "same"), scaled=True)
    return rows.select("o_orderkey", *(F.round(c, 6).alias(n) for n, c in zip(("z", "empty", "constant"), made.columns(), strict=True)))


IMPUTE_SQL = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS v FROM orders), f AS (SELECT o_orderkey, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM o)) AS v FROM o)
SELECT o_orderkey, round((v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f), 6) AS z, 0E0 AS empty, 0E0 AS constant FROM f"""


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a label that depends on their age and price."""
    rows = _orders(spark, sf_dir)
    basis = features.age_basis(_age(F.col("day")))
    chance = F.pmod(F.xxhash64("o_orderkey", F.lit(11)), F.lit(1000)) / 1000
    y = (chance < 1 / (1 + F.exp(1.5 - _age(F.col("day")) / 900 - F.col("o_totalprice") / 300_000))).cast("int")
    return rows.select(F.col("o_orderkey").alias("ID"), *(v.alias(k) for k, v in basis.items()), F.log1p("o_totalprice").alias("log1p_judgment_amount"), y.alias("label"))


MODEL_FEATURES = (*cohort.AGE_FEATURES, "log1p_judgment_amount")


def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _modelled(spark, sf_dir)
    return models.fit_logistic(rows, MODEL_FEATURES).predict(rows).select("ID", "label", F.round("p", 6).alias("p"))


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _modelled(spark, sf_dir)
    fitted = models.fit_boosted(rows.where("ID % 4 > 0"), MODEL_FEATURES, 20260619, validation=rows.where("ID % 4 = 0"), most=10)
    return fitted.predict(rows).select("ID", "label", F.round("p", 6).alias("p"))


def _calibrated(spark: SparkSession, sf_dir: str, isotonic_from: int) -> DataFrame:
    rows = _modelled(spark, sf_dir).select("ID", "label", F.round(F.pow(F.col("observation_age_months") / 90, F.lit(2)), 3).alias("p"))
    fitted = models.fit_calibration(rows, isotonic_from=isotonic_from)
    return rows.select("ID", "label", F.round(fitted.apply(F.col("p")), 6).alias("p"))


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, 200)


def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, 1 << 62)


def calibration_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    intercept, slope = models.calibration_line(_calibrated(spark, sf_dir, 1 << 62))
    return spark.createDataFrame([(round(intercept, 3), round(slope, 3))], "intercept double, slope double")


def feature_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.fit_logistic(_modelled(spark, sf_dir), MODEL_FEATURES).effects()
    return spark.createDataFrame([(e["feature"], e["effect_type"], round(e["value"], 4), round(e["absolute_share"], 4), e["direction"]) for e in found], "feature string, effect_type string, value double, absolute_share double, direction string")


#: SQL of its own for each query; those that fit a model, draw an allocated sample or hash a table have none.
SQL: dict[str, str | None] = {
    "coded_values": CODED_SQL, "date_parse_mixed": DATE_SQL, "bucket_age_audit": AUDIT_AGE_SQL, "company_age_features": COMPANY_AGE_SQL, "history_coverage": COVERAGE_SQL, "snapshot_features": SNAPSHOT_SQL,
    "linkage_guards": GUARDS_SQL, "linkage_ambiguous": AMBIGUOUS_SQL, "unmatched_reasons": UNMATCHED_SQL, "match_methods": METHODS_SQL, "former_name_temporal_join": _temporal_sql(), "semi_join_candidates": _candidates_sql(), "matching_funnel": MATCH_FUNNEL_SQL,
    "constraint_violations": _violations_sql(), "systematic_sample": _systematic_sql(), "adjudication_violations": VIOLATIONS_SQL, "stratum_metadata_check": STRATA_SQL, "weighted_prevalence": _prevalence_sql(), "linkage_recall": RECALL_SQL, "reviewer_agreement_kappa": KAPPA_SQL,
    "cohort_filter_funnel": FUNNEL_SQL, "model_cohort": COHORT_SQL, "prior_history_24m": HISTORY_SQL, "days_since_prior": SINCE_SQL, "split_counts": _split_counts_sql(), "split_guard": SPLIT_GUARD_SQL, "chronological_split": CHRONO_SQL, "label_mask": _mask_sql(),
    "audit_marginals": AUDIT_SQL, "population_comparison": POPULATION_SQL, "small_cell_suppression": SUPPRESS_SQL, "null_model_gain": GAIN_SQL, "cluster_bootstrap_ci": _bootstrap_sql(), "paired_bootstrap_delta": _paired_sql(), "impute_scale": IMPUTE_SQL,
    "validation_sample": None, "content_fingerprint": None, "logistic_scores": None, "gbt_scores": None, "isotonic_calibration": None, "platt_calibration": None, "calibration_slope": None, "feature_effects": None,
}
#: Queries whose SQL is the text of the same name in ``catalogue``.
SHARED_SQL = ("name_normalize", "amount_parse", "bucket_amount", "bucket_lag", "bucket_age", "age_basis_features", "amount_features", "linkage_unique_exact", "linkage_reasons", "match_by_type", "match_by_vintage", "match_coverage", "name_periods", "stratified_hash_sample", "wilson_by_stratum", "group_split", "union_missing_columns", "auc_brier_logloss", "average_precision", "capacity_metrics", "reliability_table")

QUERIES = {**catalogue.QUERIES, **{name: globals()[name] for name in (*SQL, *SHARED_SQL)}}
ORACLES = {**{k: v for k, v in catalogue.ORACLES.items() if k not in SQL}, **{k: v for k, v in SQL.items() if v}}
