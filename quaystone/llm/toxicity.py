"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models of order ``ORDER`` (labels toxic and ordinary) keep their own counts of full grams; all
lower orders are Kneser-Ney continuation counts of both classes together. A rare or new expression
backs off to the shared part, where both likelihoods agree, so it says nothing; a gram that one
class uses more moves the ratio. A word's evidence is its log-likelihood under the toxic model minus
that under the ordinary one; a document's features are length-normalised: the mean over its words,
its strongest words and the share of strong ones. A logistic fit on labelled documents that were not
counted turns them into a score from 0 to 1.

Every labelled row is counted and every one enters the logistic fit, never a held-out row (crc32 of the
id as text, mod 4, is 2). Rows fall into ``FOLDS`` folds by a hash of the id; the features of a fold's rows
come from counts of the other folds, the model that scores has the counts of all. Grams are summed and
the fit's steps taken on the cluster; the driver holds one model at a time, which grows with the distinct
grams of the labelled texts and with nothing else. Only the
text enters a score. A null text counts as empty; empty texts get the score of no evidence. Null
labels are left out, of several labels of an id the largest counts. Without labels of both classes,
or with too few for the folds to have both, every score is 0. Rows keep their number, equal texts get equal scores, and a score equal to the threshold
counts as toxic; the text stays, other columns pass through, and a column named like an output (in any
case of letters) is replaced. Texts are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_shuffles, row_chunks, shared_checkpoint

ORDER = 5
CODE_BITS = 12
DISCOUNT = 0.75
FOLDS = 4
#: Characters of text whose words a task counts before it emits their grams.
COUNTED_CHARS = 4 << 20
#: Bits that tell labelled ids apart before texts are exchanged.
ID_BITS = 1 << 27
#: Columns of the features.
FEATURES = [f"x{k}" for k in range(6)]
THRESHOLD = 0.3
STRONG = 2.5
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
#: Longest word taken whole; a longer one is cut into such parts.
LONGEST = 64
_MASK = (1 << CODE_BITS) - 1


def words(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)] if any(len(w) > LONGEST for w in found) else found


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of all words, one for each character and end, and how many each word has."""
    sizes = np.array([len(w) + 1 for w in vocabulary], np.int64)
    points = np.frombuffer("\x01".join([*vocabulary, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(points <= _MASK, points, 0x100 + points % (_MASK - 0x100))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros(len(codes), np.int64)
    for back in range(ORDER - 1, -1, -1):
        own = np.zeros(len(codes), np.int64)
        if back:
            own[back:] = np.where(place[back:] >= back, codes[:-back], 0)
        else:
            own = codes
        out = (out << CODE_BITS) | own
    return out, sizes


@dataclass
class Model:
    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray
    weights: np.ndarray | None = None

    def word_ratios(self, vocabulary: list[str]) -> np.ndarray:
        keys, sizes = grams(vocabulary)
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        up = np.minimum(np.searchsorted(self.contexts, keys >> CODE_BITS), len(self.contexts) - 1)
        back = np.where(self.contexts[up] == keys >> CODE_BITS, self.context_ratios[up], 0.0)
        each = np.where(self.grams[at] == keys, self.ratios[at], back)
        return np.add.reduceat(each, np.cumsum(sizes) - sizes)

    def features(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        rows = [words(t) for t in texts]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list({w for row in rows for w in row}.difference(cache))
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            cache.update(zip(part, self.word_ratios(part).tolist(), strict=True))
        out = np.zeros((len(rows), len(FEATURES)))
        for i, row in enumerate(rows):
            if row:
                x = np.fromiter(map(cache.__getitem__, row), float, len(row))
                top = -np.sort(-np.partition(x, -min(3, len(x)))[-3:])
                strong = x[x > STRONG]
                out[i] = (x.mean() * 10, min(top[0], 12), min(top.mean(), 12), np.log1p(len(strong)), np.log1p(100 * len(strong) / len(x)), min(np.maximum(x, -2).mean() * 10, 12))
        return out

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        x = self.features(texts, cache)
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def _shared(unique: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of ``order - 1`` of sorted unique grams and their shared probabilities."""
    mask = (1 << (CODE_BITS * (order - 1))) - 1
    suffixes, counts = np.unique(unique & mask, return_counts=True)
    if order == 2:
        return suffixes, counts / counts.sum()
    below, lower = _shared(suffixes, order - 1)
    contexts, inverse, types = np.unique(suffixes >> CODE_BITS, return_inverse=True, return_counts=True)
    totals = np.bincount(inverse, weights=counts)
    base = lower[np.searchsorted(below, suffixes & (mask >> CODE_BITS))]
    return suffixes, np.maximum(counts - DISCOUNT, 0) / totals[inverse] + DISCOUNT * types[inverse] / totals[inverse] * base


def fit_counts(keys: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> Model:
    """The two models' log ratios from gram counts of both classes."""
    order = np.argsort(keys)
    keys, counts = keys[order], (toxic[order], plain[order])
    suffixes, shared = _shared(keys, ORDER)
    base = shared[np.searchsorted(suffixes, keys & ((1 << (CODE_BITS * (ORDER - 1))) - 1))]
    contexts, inverse = np.unique(keys >> CODE_BITS, return_inverse=True)
    logs, backs = [], []
    for count in counts:
        totals = np.bincount(inverse, weights=count)
        types = np.bincount(inverse, weights=count > 0)
        back = np.where(totals > 0, DISCOUNT * types / np.maximum(totals, 1), 1.0)
        own = np.maximum(count - DISCOUNT, 0) / np.maximum(totals[inverse], 1)
        logs.append(np.log(own + back[inverse] * base))
        backs.append(np.log(back))
    return Model(keys, logs[0] - logs[1], contexts, backs[0] - backs[1])


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Curvature and slope of the log-likelihood over these rows, flat; sums over parts of the rows add up."""
    x = np.c_[x, np.ones(len(x))]
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (y - p)])


def fit_logistic(rows: DataFrame, ridge: float = 1e-2) -> np.ndarray:
    """Weights of ``FEATURES`` and a constant for ``y``: Newton's steps, each summed over all rows where they lie."""
    size = len(FEATURES) + 1
    w = np.zeros(size)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6

    def step_sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size * size + size)
            for b in batches:
                total += newton_sums(np.column_stack([b.column(c).to_numpy() for c in FEATURES]), b.column("y").to_numpy().astype(float), w)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tolist()])], names=["part", "sums"])

        found = rows.mapInArrow(run, "part int, sums array<double>").collect()  # one row a task
        return np.sum([r["sums"] for r in sorted(found, key=lambda r: r["part"])], axis=0)

    for _ in range(50):
        sums = step_sums(w)
        curvature, slope = sums[: size * size].reshape(size, size), sums[size * size :]
        step = np.linalg.solve(curvature + np.diag(penalty), slope - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def _counts(rows: DataFrame) -> DataFrame:
    """Sums of each gram by fold and class, from rows of text, label and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[Counter, Counter]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for fold, counters in sorted(by.items()):
                vocabulary = list(counters[0].keys() | counters[1].keys())
                if vocabulary:
                    keys, sizes = grams(vocabulary)
                    unique, inverse = np.unique(keys, return_inverse=True)
                    sums = [np.bincount(inverse, weights=np.repeat([c[w] for w in vocabulary], sizes), minlength=len(unique)).astype(np.int64) for c in counters]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), fold, np.int32)), pa.array(unique), *map(pa.array, sums)], names=["fold", "gram", "toxic", "plain"])
            by.clear()

        for batch in batches:
            for lo, hi in row_chunks(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                for t, y, fold in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    by.setdefault(fold, (Counter(), Counter()))[0 if y else 1].update(words(t))
                    size += len(t or "")
                if size >= COUNTED_CHARS:
                    yield from emit()
                    size = 0
        yield from emit()

    counted = rows.mapInArrow(run, "fold int, gram long, toxic long, plain long")
    return counted.groupBy("fold", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _model(counts: DataFrame) -> Model | None:
    """The model of these counts; None without both classes."""
    sums = counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).toArrow()  # one row a distinct gram
    keys, toxic, plain = (sums.column(i).to_numpy() for i in range(3))
    if not len(keys) or not toxic.any() or not plain.any():
        return None
    return fit_counts(keys, toxic.astype(float), plain.astype(float))


def _perhaps_in(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose ``__id`` is in ``known``, and few others: one bit a hash, at most 16 MB whatever ``known`` holds. A join has to follow."""
    spot = F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(ID_BITS))
    bits = shared_checkpoint(known.groupBy(F.bitmap_bucket_number(spot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("__bits")))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "__bucket").where(there)
    return found.select(rows.columns)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on all labelled rows that are not held out; None without both classes."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(id_column).agg(F.max(label).cast("int").alias("y"))
    known = shared_checkpoint(known.select(F.col(id_column).alias("__id"), "y"))
    if known.isEmpty():
        return None
    fold = F.pmod(F.xxhash64(F.col(id_column), F.lit(7)), F.lit(FOLDS)).cast("int")
    free = docs.where(F.col(id_column).isNotNull() & ~held_out(id_column)).select(F.col(id_column).alias("__id"), F.col(text).alias("__t"), fold.alias("__fold"))
    if free.schema["__id"].dataType == known.schema["__id"].dataType:  # hashes of different types differ
        free = _perhaps_in(free, known)
    counts = shared_checkpoint(_counts(free.join(known.hint("merge"), "__id").select("__t", "y", "__fold")))
    free_shuffles(docs.sparkSession)
    parts = []
    for k in range(FOLDS):
        if (others := _model(counts.where(F.col("fold") != k))) is None:
            continue
        shipped = docs.sparkSession.sparkContext.broadcast(others)

        def features(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            cache: dict[str, float] = {}
            for batch in batches:
                for lo, hi in row_chunks(batch.column(1)):
                    part = batch.slice(lo, hi - lo)
                    x = shipped.value.features(part.column(1).to_pylist(), cache)
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["__id", *FEATURES])

        rows = free.where(F.col("__fold") == k).select("__id", "__t")
        fields = [rows.schema["__id"], *(T.StructField(c, T.DoubleType()) for c in FEATURES)]
        # Features come before labels are joined, so that numbers are exchanged and no texts.
        parts.append(shared_checkpoint(rows.mapInArrow(features, T.StructType(fields)).join(known, "__id").select("y", *FEATURES)))
        shipped.unpersist()
    model = _model(counts)
    if model is None or not parts:
        return None
    rows = reduce(DataFrame.unionAll, parts).coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    if rows.select("y").distinct().count() < 2:
        return None
    model.weights = fit_logistic(rows)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score and predicted."""
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")))
    if model is None:
        return out.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for lo, hi in row_chunks(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                s = shipped.value.scores(part.column(text).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
