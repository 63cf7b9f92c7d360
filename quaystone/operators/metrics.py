"""Metrics of predictions, from one table with a row for each distinct probability, and their bootstrap intervals.

Ranks and running totals come from ``order``: no window over all rows, whatever their number. A bootstrap
draws whole clusters by hashes, so a replicate is the same on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import clip_probability
from .order import probability_bucket, running_sums, with_position

FRACTIONS = (0.01, 0.02, 0.05, 0.10, 0.20)


def fraction_name(fraction: float) -> str:
    return f"{round(fraction * 100)}pct"


def by_probability(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row a distinct clipped probability: n, pos, and both summed from the highest probability down to it."""
    rows = df.select(clip_probability(F.col(p)).alias("p"), F.col(y).cast("long").alias("y"))
    return running_sums(rows, "p", probability_bucket(F.col("p"), descending=True), {"n": F.lit(1), "pos": F.col("y")}, descending=True)


def evaluate(df: DataFrame, p: str = "p", y: str = "y", training_prevalence: float | None = None) -> DataFrame:
    """One row of metrics; AUC is null with one class, average precision without positives."""
    table = by_probability(df, p, y)
    total = table.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    rows = table.join(F.broadcast(total)).withColumns({"all_neg": F.col("all_n") - F.col("all_pos"), "neg": F.col("n") - F.col("pos")})
    # A positive beats the negatives below it, and half of those at its probability.
    below = F.col("all_neg") - (F.col("n_upto") - F.col("pos_upto"))
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    size, positives = F.max("all_n"), F.max("all_pos")
    negatives = size - positives
    precise = F.sum(F.col("pos") * F.col("pos_upto") / F.col("n_upto"))
    brier = F.sum(F.col("pos") * F.pow(1 - F.col("p"), F.lit(2)) + F.col("neg") * F.pow("p", F.lit(2))) / size
    loss = -F.sum(F.col("pos") * F.ln("p") + F.col("neg") * F.ln(1 - F.col("p"))) / size
    mean = F.sum(F.col("n") * F.col("p")) / size
    out = rows.agg(
        size.alias("n"),
        positives.alias("n_positive"),
        negatives.alias("n_negative"),
        (positives / size).alias("base_rate"),
        mean.alias("mean_prediction"),
        F.when((positives > 0) & (negatives > 0), won / (positives * negatives)).alias("roc_auc"),
        F.when(positives > 0, precise / positives).alias("average_precision"),
        brier.alias("brier"),
        loss.alias("log_loss"),
        F.abs(mean - positives / size).alias("calibration_gap"),
    )
    if training_prevalence is None:
        return out
    q = min(max(training_prevalence, 1e-6), 1 - 1e-6)
    base = F.col("base_rate")
    null_brier = base * (1 - q) ** 2 + (1 - base) * q**2
    null_loss = -(base * math.log(q) + (1 - base) * math.log(1 - q))
    return out.withColumns({"null_training_prevalence": F.lit(q), "null_brier": null_brier, "brier_improvement_vs_null": null_brier - F.col("brier"), "null_log_loss": null_loss, "log_loss_improvement_vs_null": null_loss - F.col("log_loss")})


def capacity(df: DataFrame, p: str = "p", y: str = "y", key: str = "id", fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """For each fraction the rows of highest probability (ties by key): how many, positives among them, rate, lift and recall."""
    rows = df.select(clip_probability(F.col(p)).alias("p"), F.col(y).cast("long").alias("y"), F.col(key).alias("k"))
    facts = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, positives = facts["n"], facts["pos"] or 0
    if not n:
        raise ValueError("no prediction to rank")
    sizes = [max(1, math.ceil(n * f)) for f in fractions]
    placed = with_position(rows, [], probability_bucket(F.col("p"), descending=True), [F.col("p").desc(), F.col("k")]).where(F.col("position") < max(sizes))
    # One pass for all fractions: no row is repeated.
    sums = placed.agg(*(F.coalesce(F.sum(F.when(F.col("position") < k, F.col("y"))), F.lit(0)).alias(f"h{i}") for i, k in enumerate(sizes)))
    stack = ", ".join(f"{f}D, {k}L, h{i}" for i, (f, k) in enumerate(zip(fractions, sizes, strict=True)))
    out = sums.select(F.expr(f"stack({len(sizes)}, {stack}) AS (fraction, selected, selected_positive)"))
    rate, base = F.col("selected_positive") / F.col("selected"), positives / n
    return out.withColumns({"selected_negative": F.col("selected") - F.col("selected_positive"), "positive_rate": rate, "lift": rate / base if base else F.lit(None).cast("double"), "recall": F.col("selected_positive") / positives if positives else F.lit(None).cast("double")})


def reliability(df: DataFrame, p: str = "p", y: str = "y", key: str = "id", bins: int = 10) -> DataFrame:
    """Equal-count bins by probability (ties by key), the larger ones first: size, positives, means, least and most."""
    rows = df.select(clip_probability(F.col(p)).alias("p"), F.col(y).cast("long").alias("y"), F.col(key).alias("k"))
    n = rows.count()
    if not n or bins < 1:
        raise ValueError("no prediction, or no bin")
    bins = min(bins, n)
    small, more = divmod(n, bins)
    placed = with_position(rows, [], probability_bucket(F.col("p")), [F.col("p"), F.col("k")])
    at = F.col("position")
    edge = more * (small + 1)
    number = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / max(small, 1))) + 1
    grouped = placed.groupBy(number.cast("long").alias("bin"))
    return grouped.agg(F.count("*").alias("rows"), F.sum("y").alias("positive"), (F.count("*") - F.sum("y")).alias("negative"), F.avg("p").alias("mean_prediction"), F.avg(F.col("y").cast("double")).alias("observed_rate"), F.min("p").alias("min_prediction"), F.max("p").alias("max_prediction"))


def draws(clusters: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, cluster, weight): how often a replicate, of as many draws as there are clusters, takes each cluster.

    Draw j of replicate r takes the cluster at position sha256(seed|r|j) modulo their number, in order of a digest.
    """
    keyed = clusters.select(cluster).distinct().withColumn("__digest", F.sha2(F.concat(F.lit(f"{seed}|cluster|"), F.col(cluster).cast("string")), 256))
    placed = with_position(keyed, [], F.substring("__digest", 1, 3), [F.col("__digest"), F.col(cluster)], "__at").drop("__digest")
    count = placed.count()
    taken = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "replicate", "draw"), 256), 1, 12), 16, 10).cast("long") % count
    spark = clusters.sparkSession
    drawn = spark.range(replicates * count).select((F.col("id") / count).cast("long").alias("replicate"), (F.col("id") % count).alias("draw"))
    weights = drawn.groupBy("replicate", taken.alias("__at")).agg(F.count("*").alias("weight"))
    return weights.join(placed, "__at").select("replicate", cluster, "weight")


def replicated(df: DataFrame, weights: DataFrame, cluster: str, p: list[str], y: str = "y") -> DataFrame:
    """One row a replicate and distinct (probabilities, label): n rows. Rows are summed within clusters before the join."""
    rows = df.groupBy(cluster, *p, y).agg(F.count("*").alias("n"))
    return rows.join(weights, cluster).groupBy("replicate", *p, y).agg(F.sum(F.col("n") * F.col("weight")).alias("n"))


def replicate_metrics(table: DataFrame, p: str = "p", y: str = "y", training_prevalence: float | None = None, fractions: tuple[float, ...] = ()) -> DataFrame:
    """Metrics of each replicate of a table (replicate, p, y, n); replicates with one class give no row.

    A capacity's boundary falls inside a tie in proportion, as the order of rows drawn several times has no meaning.
    """
    own = table.groupBy("replicate", F.col(p).alias("p")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(y) == 1, F.col("n")).otherwise(0)).alias("pos"))
    down = Window.partitionBy("replicate").orderBy(F.col("p").desc())
    whole = Window.partitionBy("replicate")
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = own.withColumns({"n_upto": F.sum("n").over(upto), "pos_upto": F.sum("pos").over(upto), "all_n": F.sum("n").over(whole), "all_pos": F.sum("pos").over(whole)})
    neg, q = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    size, positives = F.max("all_n"), F.max("all_pos")
    won = F.sum(F.col("pos") * (q - (F.col("n_upto") - F.col("pos_upto")) + neg / 2))
    brier = F.sum(F.col("pos") * F.pow(1 - F.col("p"), F.lit(2)) + neg * F.pow("p", F.lit(2))) / size
    parts = {
        "roc_auc": won / (positives * (size - positives)),
        "average_precision": F.sum(F.col("pos") * F.col("pos_upto") / F.col("n_upto")) / positives,
        "brier": brier,
        "log_loss": -F.sum(F.col("pos") * F.ln("p") + neg * F.ln(1 - F.col("p"))) / size,
        "calibration_gap": F.abs(F.sum(F.col("n") * F.col("p")) / size - positives / size),
    }
    if training_prevalence is not None:
        t = min(max(training_prevalence, 1e-6), 1 - 1e-6)
        parts["brier_improvement_vs_null"] = (positives * (1 - t) ** 2 + (size - positives) * t**2) / size - brier
    for f in fractions:
        k = F.greatest(F.lit(1), F.ceil(F.col("all_n") * f))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k - (F.col("n_upto") - F.col("n"))) / F.col("n")))
        hits, name = F.sum(F.col("pos") * share), f"capacity_{fraction_name(f)}"
        parts |= {f"{name}_positive_rate": hits / F.max(k), f"{name}_lift": hits / F.max(k) / (positives / size), f"{name}_recall": hits / positives}
    return rows.where((F.col("all_pos") > 0) & (F.col("all_pos") < F.col("all_n"))).groupBy("replicate").agg(*(v.alias(k) for k, v in parts.items()))


def intervals(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(metric, lower, upper): percentiles with linear interpolation over the replicates that have a value."""
    names = [c for c in replicates.columns if c != "replicate"]
    low = (1 - level) / 2
    long = replicates.unpivot([], names, "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy("metric").agg(F.percentile("value", F.lit(low)).alias("lower"), F.percentile("value", F.lit(1 - low)).alias("upper"))


def bootstrap(df: DataFrame, replicates: int, seed: int, p: str = "p", y: str = "y", cluster: str = "cluster", training_prevalence: float | None = None, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Percentile intervals of the metrics, by draws of whole clusters; no row with fewer than two clusters or one class."""
    rows = df.select(F.col(cluster).alias("cluster"), clip_probability(F.col(p)).alias("p"), F.col(y).cast("int").alias("y"))
    facts = rows.agg(F.count_distinct("cluster").alias("c"), F.min("y").alias("least"), F.max("y").alias("most")).first()
    if facts["c"] < 2 or facts["least"] == facts["most"]:
        return df.sparkSession.createDataFrame([], "metric string, lower double, upper double")
    table = replicated(rows, draws(rows, "cluster", replicates, seed), "cluster", ["p"])
    return intervals(replicate_metrics(table, training_prevalence=training_prevalence, fractions=fractions))


def stratified_draws(df: DataFrame, replicates: int, seed: int, key: str = "id", y: str = "y") -> DataFrame:
    """As ``draws`` for rows without clusters: each class is drawn from for itself, as often as it has rows."""
    out = None
    for label in (0, 1):
        own = draws(df.where(F.col(y) == label).select(key), key, replicates, seed + label)
        out = own if out is None else out.union(own)
    return out


def paired_deltas(candidate: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """Differences of metrics; a positive one speaks for the candidate, so losses are turned round."""
    names = [c for c in candidate.columns if c not in on]
    turned = {"brier": "brier_improvement_vs_age_only", "log_loss": "log_loss_improvement_vs_age_only"}
    joined = candidate.alias("a").join(base.alias("b"), on) if on else candidate.alias("a").join(F.broadcast(base).alias("b"))
    of = lambda c: (F.col(f"b.{c}") - F.col(f"a.{c}")).alias(turned[c]) if c in turned else (F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"delta_{c}")
    return joined.select(*on, *(of(c) for c in names if c not in ("calibration_gap", "brier_improvement_vs_null")))


def paired_bootstrap(df: DataFrame, candidate: str, base: str, replicates: int, seed: int, y: str = "y", cluster: str = "cluster", fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Intervals of the differences of two predictions of the same rows, under the same draws."""
    rows = df.select(F.col(cluster).alias("cluster"), clip_probability(F.col(candidate)).alias("pa"), clip_probability(F.col(base)).alias("pb"), F.col(y).cast("int").alias("y"))
    table = replicated(rows, draws(rows, "cluster", replicates, seed), "cluster", ["pa", "pb"])
    side = lambda p: replicate_metrics(table, p=p, fractions=fractions)
    return intervals(paired_deltas(side("pa"), side("pb"), ["replicate"]))

