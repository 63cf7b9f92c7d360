"""The judgment register: a closed schema of text columns, read, renamed, typed and held against its rules.

The file is read by Spark; rules are counted in one aggregate each for values and for repeated IDs, and the first
broken one raises. Nothing is dropped or repaired in silence.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_is_invalid, days_between, observation_day, parse_date
from ..functions.features import REGISTER_MONTH
from ..functions.text import amount_is_invalid, canon_header, decoded, parse_amount
from ..operators.checks import DataError, require_none

# The register's columns, the headings that stand for them, and the codes of three of them.
REQUIRED = ("ID", "Date Inserted", "JudgmentDate", "JudgmentStatus", "DefendantType", "Jurisdiction", "Defendant Company Name", "Defendant_Postcode")
OPTIONAL = ("Amount", "Defendant Trading Name", "Defendant Address", "Satisfaction Date", "Cancellation Date", "Cancellation Reason", "Status Effective Date", "Snapshot Date")
OPTIONAL_DATES = ("Satisfaction Date", "Cancellation Date", "Status Effective Date", "Snapshot Date")
HEADINGS = {
    "ID": ("id",),
    "Date Inserted": ("dateinserted",),
    "JudgmentDate": ("judgmentdate",),
    "JudgmentStatus": ("judgmentstatus",),
    "DefendantType": ("defendanttype",),
    "Jurisdiction": ("jurisdiction",),
    "Defendant Company Name": ("defendantcompanyname", "companyname"),
    "Defendant_Postcode": ("defendantpostcode", "postcode"),
    "Amount": ("amount",),
    "Defendant Trading Name": ("defendanttradingname", "tradingname"),
    "Defendant Address": ("defendantaddress", "address"),
    "Satisfaction Date": ("satisfactiondate", "datesatisfied", "satisfieddate", "dateofsatisfaction"),
    "Cancellation Date": ("cancellationdate", "datecancelled", "datecanceled", "cancelleddate", "canceleddate", "dateofcancellation"),
    "Cancellation Reason": ("cancellationreason", "reasonforcancellation", "cancelreason", "reasoncancelled", "reasoncanceled"),
    "Status Effective Date": ("statuseffectivedate", "statusdate", "statuschangedate", "dateofstatus"),
    "Snapshot Date": ("snapshotdate", "extractdate", "asofdate", "dataasofdate", "observationdate"),
}
DECISIVE = ("satisf", "cancel", "status", "snapshot", "asof", "effective", "history", "payment", "paid", "settle", "remov", "setaside")
CODES = {
    "JudgmentStatus": {"satisfied": "Satisfied", "unsatisfied": "Unsatisfied", "cancelled": "Cancelled", "canceled": "Cancelled"},
    "DefendantType": {"corporate": "Corporate", "non corporate": "Non-Corporate", "noncorporate": "Non-Corporate", "consumer": "Consumer", "non consumer": "Non-Consumer", "nonconsumer": "Non-Consumer"},
    "Jurisdiction": {"england and wales": "England and Wales", "england wales": "England and Wales", "scotland": "Scotland"},
}


# Windows-1252 is Latin-1 but for the bytes from 0x80 to 0x9F, some of which it leaves undefined.
_HIGH = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
WINDOWS = "".join(c for c, w in _HIGH.items() if w), "".join(_HIGH.values())
UNDEFINED = "".join(c for c, w in _HIGH.items() if not w)


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, list[str]]:
    """(table of text columns c0, c1, ..., their headings). UTF-8, or Windows-1252 where a line isn't.

    Empty cells are empty text. ``multi_line`` reads line breaks inside quotes, one task a file; without it files are split.
    """
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        raise DataError(f"{path} is empty")
    utf8 = lines.where(~F.is_valid_utf8("value")).isEmpty()
    options = {"escape": '"', "multiLine": multi_line, "encoding": "UTF-8" if utf8 else "ISO-8859-1"}
    whole = spark.read.options(header=False, **options).csv(path).first()
    headings = [_windows(str(v or ""), utf8).lstrip("\ufeff") for v in whole]
    table = spark.read.options(header=True, enforceSchema=True, mode="PERMISSIVE", **options).schema(", ".join(f"c{i} string" for i in range(len(headings)))).csv(path)
    if not utf8:
        bad = F.lit(False)
        for c in table.columns:
            bad = bad | F.coalesce(F.col(c).rlike(f"[{UNDEFINED}]"), F.lit(False))
        require_none(table, {"bytes that are neither UTF-8 nor Windows-1252": bad}, path)
        table = table.select(*(F.translate(c, *WINDOWS).alias(c) for c in table.columns))
    return table.select(*(F.coalesce(c, F.lit("")).alias(c) for c in table.columns)), headings


def _windows(text: str, utf8: bool) -> str:
    return text if utf8 else text.translate(str.maketrans(*WINDOWS))


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A CSV file, or the first sheet of a workbook on the driver's disk; other kinds raise."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind == "csv":
            return read_csv_text(spark, path)
        if kind in ("xlsx", "xlsm"):
            from .files import read_xlsx

            headings, rows = read_xlsx(path.removeprefix("file://"))
            return spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(headings)))), headings
    except DataError:
        raise
    except Exception as fault:
        raise DataError(f"{path} can't be read: {type(fault).__name__}") from fault
    raise DataError(f"{path} is neither CSV nor a workbook")


def standardised(table: DataFrame, headings: list[str]) -> tuple[DataFrame, dict[str, Any]]:
    """(table of the declared columns in order, facts about headings). Two headings for one column, a missing required one and an unknown decisive one raise."""
    known = {alias: name for name, aliases in HEADINGS.items() for alias in aliases}
    found: dict[str, int] = {}
    extra, schema = [], []
    for i, heading in enumerate(headings):
        canon = canon_header(heading)
        name = known.get(canon)
        schema.append((heading, name or ""))
        if name is None:
            if any(part in canon for part in DECISIVE):
                raise DataError(f"unknown column about an outcome: {heading!r}")
            extra.append(heading)
        elif name in found:
            raise DataError(f"{headings[found[name]]!r} and {heading!r} both stand for {name}")
        else:
            found[name] = i
    if missing := [c for c in REQUIRED if c not in found]:
        raise DataError(f"no column for {', '.join(missing)}")
    cell = lambda c: F.trim(F.coalesce(F.col(table.columns[found[c]]), F.lit(""))) if c in found else F.lit("")
    absent = [c for c in OPTIONAL if c not in found]
    return table.select(*(cell(c).alias(c) for c in (*REQUIRED, *OPTIONAL))), {"raw_headers": list(headings), "raw_header_schema": schema, "extra_headers": extra, "absent_optional_columns": absent}


def data_construct(present: set[str]) -> str:
    events, snapshot = bool(present & {"Satisfaction Date", "Cancellation Date", "Status Effective Date"}), "Snapshot Date" in present
    return "cross_sectional_status" + {(False, False): "_only", (True, True): "_with_event_dates_and_snapshot_date", (True, False): "_with_event_dates", (False, True): "_with_snapshot_date"}[events, snapshot]


def timing_rules(present: set[str], observed: dt.date) -> dict[str, Column]:
    """Contradictions between days and status, as conditions on typed rows, in the order in which they are told."""
    day, status, now = F.col("JudgmentDate"), F.col("JudgmentStatus"), F.lit(observed)
    filled = lambda c: F.col(c).isNotNull()
    out: dict[str, Column] = {}
    for c in OPTIONAL_DATES:
        if c in present:
            out |= {f"{c} before JudgmentDate": F.col(c) < day, f"{c} after the observation": F.col(c) > now}
    satisfied, cancelled, effective = (F.col(c) for c in OPTIONAL_DATES[:3])
    if "Satisfaction Date" in present:
        out |= {"Satisfied without Satisfaction Date": (status == "Satisfied") & satisfied.isNull(), "Unsatisfied with Satisfaction Date": (status == "Unsatisfied") & satisfied.isNotNull()}
    if "Cancellation Date" in present:
        out |= {"Cancelled without Cancellation Date": (status == "Cancelled") & cancelled.isNull(), "Cancellation Date on another status": (status != "Cancelled") & cancelled.isNotNull()}
    if "Cancellation Reason" in present:
        out["Cancellation Reason on another status"] = (status != "Cancelled") & (F.col("Cancellation Reason") != "")
    out["Cancellation Date before Satisfaction Date"] = cancelled < satisfied
    if "Status Effective Date" in present:
        out["Status Effective Date before its event"] = ((status == "Satisfied") & (effective < satisfied)) | ((status == "Cancelled") & (effective < cancelled))
    if "Snapshot Date" in present:
        out |= {"Snapshot Date is missing": ~filled("Snapshot Date"), "Snapshot Date is not the observation": F.col("Snapshot Date") != now}
    return out


def typed(raw: DataFrame, observed: dt.date) -> DataFrame:
    """The register's types: codes spelt out, days, an amount, and the lag and age of each judgment."""
    dates = ("Date Inserted", "JudgmentDate", *OPTIONAL_DATES)
    out = raw.withColumns({c: decoded(F.col(c), v) for c, v in CODES.items()} | {c: parse_date(F.col(c)) for c in dates} | {"Amount": parse_amount(F.col("Amount"))})
    age = days_between(F.lit(observed), F.col("JudgmentDate"))
    return out.withColumns({"registration_lag_days": days_between(F.col("Date Inserted"), F.col("JudgmentDate")), "age_at_observation_days": age, "age_at_observation_months": age / F.lit(REGISTER_MONTH)})


def require_ids(raw: DataFrame, snapshot: bool) -> None:
    facts = raw.groupBy("ID").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("ID") == "", F.col("n"))).alias("blank"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("repeated")).first()
    if not facts["rows"]:
        raise DataError("register: no row")
    if facts["blank"]:
        raise DataError(f"register: ID is blank in {facts['blank']} rows")
    if facts["repeated"]:
        raise DataError("register: repeated IDs beside a Snapshot Date are a history, which this reader can't take" if snapshot else f"register: {facts['repeated']} rows share an ID")


def audit(table: DataFrame, raw: DataFrame, facts: dict[str, Any], observed: dt.date, source_sha256: str = "") -> dict[str, Any]:
    """Counts, ranges and fingerprints of a typed register, without any identifier."""
    from ..operators.release import content_fingerprint, provenance_hash, sequence_hash

    number = {"registration_lag_days": "registration_lag_days", "age_at_observation_months": "age_at_observation_months"}
    ranges = [f(n).alias(f"{n}_{k}") for n in number for k, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    blank = {"missing_company_name_rows": "Defendant Company Name", "missing_postcode_rows": "Defendant_Postcode"}
    filled = {f"{c.lower().replace(' ', '_')}_present_rows": F.count(c) for c in OPTIONAL_DATES} | {"cancellation_reason_present_rows": F.count_if(F.col("Cancellation Reason") != "")}
    row = table.agg(
        F.count("*").alias("rows"),
        F.count_distinct("Date Inserted").alias("date_inserted_distinct"),
        F.min("JudgmentDate").alias("judgment_date_min"),
        F.max("JudgmentDate").alias("judgment_date_max"),
        *ranges,
        F.count_if(F.col("Date Inserted") < F.col("JudgmentDate")).alias("date_inserted_before_judgment_rows"),
        F.count_if(F.col("Date Inserted") > F.lit(observed)).alias("date_inserted_after_observation_rows"),
        *(F.count_if(F.col(c) == "").alias(k) for k, c in blank.items()),
        *(v.alias(k) for k, v in filled.items()),
    ).first()
    out = row.asDict() | facts
    out["invalid_amount_rows"] = raw.agg(F.count_if(amount_is_invalid(F.col("Amount")))).first()[0]
    for column, name in (("JudgmentStatus", "status_counts"), ("DefendantType", "defendant_type_counts"), ("Jurisdiction", "jurisdiction_counts")):
        out[name] = {r[0]: r[1] for r in table.groupBy(column).count().collect()}  # closed vocabularies
    present = set(OPTIONAL) - set(facts["absent_optional_columns"])
    out |= {"observation_date": observed.isoformat(), "data_construct": data_construct(present), "event_date_columns_present": [c for c in OPTIONAL_DATES[:-1] if c in present], "historical_snapshots_available": False}
    out["raw_header_schema_sha256"] = sequence_hash(facts["raw_header_schema"])
    out["analysis_fingerprint"] = content_fingerprint(table).first()["fingerprint"]
    out["raw_source_sha256"] = source_sha256
    out["provenance_fingerprint"] = provenance_hash(source=source_sha256, headers=out["raw_header_schema_sha256"], analysis=out["analysis_fingerprint"])
    return out


def read_register(spark: SparkSession, path: str, observation: str | dt.date) -> tuple[DataFrame, dict[str, Any]]:
    """(typed register, audit) of a file; whatever breaks a rule raises."""
    observed = observation_day(observation)
    raw, facts = standardised(*read_table(spark, path))
    present = set(OPTIONAL) - set(facts["absent_optional_columns"])
    require_ids(raw, "Snapshot Date" in present)
    rules = {f"{c} has an unknown value": decoded(F.col(c), values).isNull() for c, values in CODES.items()}
    rules |= {f"{c} is no day": parse_date(F.col(c)).isNull() for c in ("Date Inserted", "JudgmentDate")}
    rules |= {f"{c} is no day": date_is_invalid(F.col(c)) for c in OPTIONAL_DATES}
    require_none(raw, rules, "register")
    table = typed(raw, observed)
    require_none(table, {"JudgmentDate after the observation": F.col("JudgmentDate") > F.lit(observed)} | timing_rules(present, observed), "register")
    digests = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    return table, audit(table, raw, facts, observed, "".join(r["h"] for r in digests))
