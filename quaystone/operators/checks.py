"""Assertions over tables: every rule is a counted condition of one aggregate, and the first broken one raises."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """A table breaks a rule of its contract."""


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise DataError(f"{what}: no column {', '.join(missing)}")


def require_unique(df: DataFrame, key: str, what: str) -> None:
    """No null, blank or repeated key; one shuffle of the keys alone."""
    text = F.trim(F.col(key).cast("string"))
    row = df.groupBy(text.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.coalesce("k", F.lit("")) == "", F.col("n"))), F.lit(0)).alias("blank"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated")).first()
    if row["blank"]:
        raise DataError(f"{what}: {key} is blank in {row['blank']} rows")
    if row["repeated"]:
        raise DataError(f"{what}: {row['repeated']} rows share a value of {key}")


def count_violations(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """How many rows break each rule (a condition that holds for a broken row), in one pass."""
    if not rules:
        return {}
    row = df.agg(*(F.count_if(F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values()))).first()
    return {name: row[f"r{i}"] for i, name in enumerate(rules)}


def require_none(df: DataFrame, rules: dict[str, Column], what: str) -> dict[str, int]:
    """Raise for the first rule, in the given order, that any row breaks."""
    found = count_violations(df, rules)
    for name, n in found.items():
        if n:
            raise DataError(f"{what}: {name} ({n} rows)")
    return found


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables hold the same set of keys."""
    marks = a.select(F.col(key).alias("k"), F.lit(1).alias("m")).union(b.select(F.col(key), F.lit(2)))
    return marks.groupBy("k").agg(F.count_distinct("m").alias("n")).where("n < 2").isEmpty()
