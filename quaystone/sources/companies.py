"""The company snapshot: CSV, or the first CSV of a ZIP file, as companies with their former names."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import canon_header
from ..operators.checks import DataError

# The snapshot's columns.
REQUIRED = ("CompanyName", "CompanyNumber", "RegAddress.PostCode", "IncorporationDate")
SNAPSHOT = ("CompanyStatus", "CompanyCategory", "Accounts.NextDueDate", "Accounts.LastMadeUpDate", "Accounts.AccountCategory", "Mortgages.NumMortCharges", "Mortgages.NumMortOutstanding", "Mortgages.NumMortPartSatisfied", "Mortgages.NumMortSatisfied")
_FORMER = re.compile(r"previousname(\d+)(companyname|condate)")
#: Rows that are handed over at once when a ZIP member is read.
BATCH_ROWS = 20_000


def standard_name(heading: str) -> str | None:
    """The snapshot column that a heading stands for; former names are numbered without limit."""
    canon = canon_header(heading)
    if match := _FORMER.fullmatch(canon):
        return f"PreviousName_{int(match[1])}.{'CompanyName' if match[2] == 'companyname' else 'CONDATE'}"
    return {canon_header(c): c for c in (*REQUIRED, *SNAPSHOT)}.get(canon)


def standardised(table: DataFrame, headings: list[str]) -> DataFrame:
    """The snapshot's columns under their names; others are never read. Two headings for one column raise."""
    found: dict[str, int] = {}
    for i, heading in enumerate(headings):
        name = standard_name(heading)
        if name in found:
            raise DataError(f"{headings[found[name]]!r} and {heading!r} both stand for {name}")
        if name is not None:
            found[name] = i
    if missing := [c for c in REQUIRED if c not in found]:
        raise DataError(f"company file: no column for {', '.join(missing)}")
    return table.select(*(F.coalesce(F.col(table.columns[i]), F.lit("")).alias(name) for name, i in found.items()))


def companies(table: DataFrame) -> DataFrame:
    """company_number, company_name, postcode, incorporation_date, former_names (array of raw_name, change_date) and the snapshot columns."""
    numbers = sorted(int(m[1]) for c in table.columns if (m := re.fullmatch(r"PreviousName_(\d+)\.CompanyName", c)))
    name = lambda n: F.trim(F.col(f"`PreviousName_{n}.CompanyName`"))
    day = lambda n: parse_date(F.col(f"`PreviousName_{n}.CONDATE`")) if f"PreviousName_{n}.CONDATE" in table.columns else F.lit(None).cast("date")
    former = F.array(*(F.when(name(n) != "", F.struct(name(n).alias("raw_name"), day(n).alias("change_date"))) for n in numbers)) if numbers else F.array()
    kept = F.filter(former.cast("array<struct<raw_name:string,change_date:date>>"), lambda x: x.isNotNull())
    return table.select(
        F.upper(F.trim("CompanyNumber")).alias("company_number"),
        F.trim("CompanyName").alias("company_name"),
        F.col("`RegAddress.PostCode`").alias("postcode"),
        parse_date(F.col("IncorporationDate")).alias("incorporation_date"),
        kept.alias("former_names"),
        *(F.trim(F.col(f"`{c}`")).alias(c) for c in SNAPSHOT if c in table.columns),
    )


def _zip_rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The first CSV member by name, read by a task as it is unpacked; undecodable bytes are replaced."""

    def reader(content: bytes) -> Iterator[list[str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = sorted(n for n in archive.namelist() if n.lower().endswith(".csv"))
            if not members:
                raise ValueError("the ZIP file holds no CSV")
            with archive.open(members[0]) as file:
                yield from csv.reader(io.TextIOWrapper(file, "utf-8", errors="replace", newline=""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[list[str]] = []
                for i, row in enumerate(reader(content.as_py())):
                    held.append([str(i), *row])
                    if len(held) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["row"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["row"])

    binary = spark.read.format("binaryFile").load(path).select("content")

    def heading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([next(reader(content.as_py()))], pa.list_(pa.string()))], names=["row"])

    first = binary.mapInArrow(heading, "row array<string>").first()
    if first is None:
        raise DataError(f"{path} is no file")
    headings = [h.lstrip("﻿") for h in first["row"]]
    rows = binary.mapInArrow(run, "row array<string>").where(F.get("row", F.lit(0)) != "0")
    # One task unpacks, as a ZIP file can't be split; what follows is dealt to all.
    dealt = rows.repartition(F.get("row", F.lit(0)))
    return dealt.select(*(F.get("row", F.lit(i + 1)).alias(f"c{i}") for i in range(len(headings)))), headings


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """The companies of a CSV or ZIP file."""
    from .register import read_csv_text

    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return companies(standardised(*read_csv_text(spark, path)))
    if kind != "zip":
        raise DataError("a company file is CSV or ZIP")
    try:
        return companies(standardised(*_zip_rows(spark, path)))
    except DataError:
        raise
    except Exception as fault:
        raise DataError(f"{path} can't be read: {type(fault).__name__}") from fault
