"""Shards of near equal bytes by sampled splitters. DataFrame functions only.

Rows are ordered by (md5 of the text, doc_id), so equal texts lie together. A size-weighted sample
of keys gives quantile boundaries; a text that fills more than one range by itself is overfull, and
its range is subdivided by doc_id. Counts and bytes before each range come from one aggregate over
the ranges, so each row's exact offset in the whole order is known after sorting within ranges, and
a shard is the 1/shards part of all bytes in which the middle of the row lies.

Law ``bytes``: a shard differs from the mean by no more than the rows (or groups) at its two edges.
Equal texts stay in one shard, unless the group is larger than a shard: then it is cut by
rows, which keeps sizes near equal when one text holds a third of all rows. Nulls: a null text
counts as no bytes and sorts as the empty text; null ids sort first. Repeated rows get slots of
their own, ties in order of the id. A long text counts whole. An empty table gives no rows. Other columns
pass through, whatever their names; outputs replace columns of the same name in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes counted for a row besides its text.
ROW_BYTES = 16
#: A group of equal texts of up to 1 / GROUP_PART of a shard is never cut.
GROUP_PART = 1
#: Samples drawn for each range.
SAMPLES = 24
#: Rows a range should hold, and the bounds on the number of ranges, and so of broadcast splitters.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 200_000, 160, 20_000


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by size, text_crc32 and the order's key."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return df.select("*", (F.length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("__key")).drop(text)


def splitters(df: DataFrame, totals, ranges: int) -> list[tuple[str, int | None]]:
    """At most ``ranges`` boundaries (key, id), at quantiles of a size-weighted sample of keys.

    A key that holds two or more boundaries is overfull: its boundaries carry ids as well.
    """
    share = F.col("size") * F.lit(float(ranges * SAMPLES)) / F.lit(float(totals["bytes"]))
    draw = (F.pmod(F.xxhash64("__key", "__id", F.lit(17)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    drawn = df.where(draw < share).groupBy("__key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("__id")).alias("ids")).orderBy("__key")
    flat = [(r["__key"], i) for r in drawn.collect() for i in r["ids"]]  # bounded: about ranges * SAMPLES keys
    step = max(1, len(flat) // ranges)
    marks = flat[step::step]
    counts: dict[str, int] = {}
    for key, _ in marks:
        counts[key] = counts.get(key, 0) + 1
    out = [(key, None) if counts[key] == 1 else (key, i) for key, i in marks]
    out += [(key, None) for key, n in counts.items() if n > 1]
    return sorted(set(out), key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def shard_by_bytes(df: DataFrame, shards: int = 40, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace the text by size, text_crc32, law, shard, slot (gapless from 0) and grown_shard (null under this law)."""
    outputs = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    # The caller's columns go by number meanwhile, so that their names can't clash with those used here.
    kept = [c for c in df.columns if c.lower() not in outputs and c != text]
    base = measured(df.select(*(F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(kept)), F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("__id"), F.col(text).alias("__text")), "__text")
    totals = base.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, 4 * shards, totals["rows"] // RANGE_ROWS))
    marks = splitters(base, totals, ranges) if totals["rows"] else []

    # The range of a row: boundaries that start with the same four hex digits lie in one array, found by one look-up.
    spark = df.sparkSession
    prefixes: dict[str, tuple[int, list]] = {}
    for at, (key, i) in enumerate(marks):
        prefixes.setdefault(key[:3], (at, []))[1].append((key, i if i is not None else -(1 << 63)))
    firsts, at = [], 0
    for n in range(16**3):
        own = prefixes.get(f"{n:03x}", (at, []))
        firsts.append((f"{n:03x}", at, own[1]))
        at += len(own[1])
    lookup = spark.createDataFrame(firsts, "prefix string, before int, marks array<struct<k:string,i:bigint>>")
    ranged = base.join(F.broadcast(lookup), F.substring("__key", 1, 3) == F.col("prefix")).withColumn("__range", F.col("before") + F.size(F.filter("marks", lambda m: (m["k"] < F.col("__key")) | ((m["k"] == F.col("__key")) & (m["i"] <= F.col("__id")))))).drop("prefix", "before", "marks")

    in_range = Window.partitionBy("__range").orderBy("__key", "__id")
    running = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("__range").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    over = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range: bounded by MOST_RANGES
    starts = sums.select("__range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("__rows_before"), F.coalesce(F.sum("b").over(over), F.lit(0)).alias("__bytes_before"))
    placed = ranged.withColumns({"__rank": F.row_number().over(in_range) - 1, "__after": F.sum("size").over(running)})
    group = Window.partitionBy("__range", "__key")
    placed = placed.withColumns({"__group": F.sum("size").over(group), "__group_start": F.min(F.col("__after") - F.col("size")).over(group)})
    placed = placed.join(F.broadcast(starts), "__range")
    whole = F.col("__group") * shards * GROUP_PART <= F.lit(totals["bytes"])
    start = F.when(whole, F.col("__group_start")).otherwise(F.col("__after") - F.col("size")) + F.col("__bytes_before")
    middle2 = 2 * start + F.when(whole, F.col("__group")).otherwise(F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle2.cast("decimal(38,0)") * shards / F.lit(2 * max(1, totals["bytes"])).cast("decimal(38,0)"))).cast("int")
    placed = placed.withColumns({"shard": shard, "__rank": F.col("__rank") + F.col("__rows_before")})
    counts = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))  # one row a shard
    out = placed.join(F.broadcast(counts), "shard").withColumns({"slot": F.col("__rank") - F.col("__first"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.select(*(F.col(f"u{i}").alias(c) for i, c in enumerate(kept)), *outputs)
