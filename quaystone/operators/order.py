"""Positions in a total order without sorting all rows in one task.

Rows are cut into buckets that respect the order; bucket sizes are summed on a small table, and ranks are
taken inside buckets. How evenly the buckets fill is up to the bucket expression; every result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a digest's first three hex digits, or of a probability.
BUCKETS = 4096


def digest_bucket(digest: Column) -> Column:
    """Buckets of a hex digest, in its order; they fill evenly."""
    return F.substring(digest, 1, 3)


def probability_bucket(p: Column, descending: bool = False) -> Column:
    at = F.least(F.greatest(F.floor(p * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
    return F.lit(BUCKETS - 1) - at if descending else at


def with_position(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in its group, in the order of (bucket, order)."""
    df = df.withColumn("__bucket", bucket)
    keys = [*group, "__bucket"]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    # One row a group and bucket, so this table is small whatever the rows are.
    starts = sizes.withColumn("__start", F.sum("__n").over(before.orderBy("__bucket")) - F.col("__n")).drop("__n")
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(inside) - 1)
    same = [ranked[k].eqNullSafe(starts[k]) for k in keys]
    return ranked.join(F.broadcast(starts), same[0] if len(same) == 1 else _all(same), "inner").select(*(ranked[c] for c in df.columns if c != "__bucket"), (F.col("__rank") + F.col("__start")).cast("long").alias(name))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def running_sums(df: DataFrame, key: str, bucket: Column, values: dict[str, Column], descending: bool = False) -> DataFrame:
    """One row a key: the sum of each value over the key, and over all keys up to and with it (``<name>_upto``)."""
    sums = df.groupBy(key).agg(*(F.sum(v).alias(n) for n, v in values.items())).withColumn("__bucket", bucket)
    totals = sums.groupBy("__bucket").agg(*(F.sum(n).alias(f"__{n}") for n in values))
    over = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    starts = totals.select("__bucket", *(F.coalesce(F.sum(f"__{n}").over(over), F.lit(0)).alias(f"__{n}") for n in values))
    inside = Window.partitionBy("__bucket").orderBy(F.col(key).desc() if descending else F.col(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.join(F.broadcast(starts), "__bucket").select(key, *values, *((F.sum(n).over(inside) + F.col(f"__{n}")).alias(f"{n}_upto") for n in values))
