r"""Secret scans: three base rules, and random-looking tokens by two character Markov models.
DataFrame functions only.

Base rules, leftmost non-overlapping for each kind, failing matches dropped:
``assign`` a credential name, a sign and a value of 8 or more characters; ``access`` AKIA and its
run, 16 or more characters in all; ``hex`` a run of 32 or more lower hex digits. The method adds
kind ``random``: tokens of any alphabet, long enough to reach the least odds, whose transitions are
likelier under a first-order chain of random strings than under one of ordinary identifiers. Both
chains are trained from labelled samples: random strings drawn from digests in five alphabets
(label 1), and words of a bounded sample of documents, in capitals too, with identifiers joined from them (label 0;
at most ``SAMPLE_DOCS`` documents). A token that overlaps a base span is not added.

Offsets are code points, ends exclusive. A null text counts as empty and has no spans. Rows keep
their number, repeated rows too; other columns pass through, whatever their names, and an output replaces
a column of its name in any case of letters. Long texts are scanned whole; of spans that start together the
lower rank comes first. An empty table trains on the random strings alone and gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Every name in ASSIGN holds one of these.
NAMES = ("password", "passwd", "secret", "token", "api")
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}+"
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+"
KINDS = ("assign", "access", "hex", "random")
#: Documents in the sample of ordinary identifiers, random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_STRINGS = 3000, 1000
#: Natural logarithm of the odds that a token must reach, in all and for each transition.
LEAST_ODDS, LEAST_MEAN = 12.0, 0.45
#: Share of the uniform distribution in both chains, so that no single transition decides on a token.
FLOOR = 0.02
SPAN = "array<struct<start:bigint,end:bigint,rank:int>>"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
SYMBOLS = 65  # of the alphabet, and one for + and /


def _matches(text: Column, pattern: str, rank: int, least: int = 0, among: Column | None = None) -> Column:
    """Spans of a pattern: what stands between matches and the matches themselves, added up from left to right; only those of the given strings, if any are given."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("own"), values.alias("value"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["own"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"))
        fits = p["own"].isNotNull() & (F.length(p["value"]) >= least)
        fits = fits if among is None else fits & F.array_contains(among, p["own"])
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    some = text.rlike(pattern) if among is None else F.size(among) > 0
    return F.when(some, F.aggregate(parts, empty, add, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def _symbols(token: Column) -> Column:
    """Indices of a token's characters."""
    codes = [SYMBOLS - 1] * 128
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i
    lut = F.split(F.lit(",".join(map(str, codes))), ",").cast("array<int>")
    return F.transform(F.split(token, ""), lambda c: F.get(lut, F.ascii(c)))


def _transitions(tokens: DataFrame, name: str) -> DataFrame:
    """Counts of the transitions of tokens that stand n times; equal tokens are counted first, so that each is cut up once."""
    distinct = tokens.where(F.length("token") > 1).groupBy("token").agg(F.sum("n").alias("n"))
    rows = fixed(distinct, s=_symbols(F.col("token")))
    pairs = rows.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.get("s", i) * SYMBOLS + F.get("s", i + 1))).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("n").alias(name))


def train(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> list[float]:
    """Log-likelihood ratios (random against ordinary) of the SYMBOLS * SYMBOLS transitions, from labelled samples."""
    total = docs.count()
    kept = max(1, round((1 << 20) * min(1.0, SAMPLE_DOCS / max(total, 1))))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 20)) < kept).select(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    # Each word with the one behind it, equal pairs counted once; the last word's neighbour is the first.
    chosen = fixed(chosen, w=F.col("w"))
    turned = F.concat(F.slice("w", 2, F.size("w")), F.slice("w", 1, 1))
    pairs = chosen.where(F.size("w") > 0).select(F.explode(F.arrays_zip(F.col("w").alias("a"), turned.alias("b"))).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    w, after, number = F.col("a"), F.col("b"), F.pmod(F.xxhash64("a"), F.lit(10_000)).cast("string")
    variants = F.array(w, F.concat(w, F.lit("_"), after), F.concat(w, F.initcap(after)), F.concat(w, F.lit("-"), after), F.concat(w, F.lit("_"), number), F.concat(w, F.lit("/"), after, F.lit("-20"), F.substr(number, F.lit(1), F.lit(2)), F.lit("-01")), F.upper(w), F.concat(F.upper(w), F.lit("_"), F.upper(after)))
    ordinary = pairs.select("n", F.explode(variants).alias("token"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    strings = docs.sparkSession.range(SAMPLE_STRINGS).select(F.explode(F.array(digest, F.upper(digest), base64, F.translate(base64, "+/", "k7"), F.translate(F.upper(base64), "+/0189", "ABCDEF"))).alias("token")).withColumn("n", F.lit(1))
    counts = _transitions(strings, "random").join(_transitions(ordinary, "plain"), "pair", "full").na.fill(0).collect()  # at most SYMBOLS ** 2 rows
    grids = [[0.5] * SYMBOLS**2, [0.5] * SYMBOLS**2]
    for row in counts:
        grids[0][row["pair"]] += row["random"]
        grids[1][row["pair"]] += row["plain"]
    chains = []
    for grid in grids:
        sums = [sum(grid[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)]
        chains.append([(1 - FLOOR) * n / sums[pair // SYMBOLS] + FLOOR / SYMBOLS for pair, n in enumerate(grid)])
    return [math.log(random) - math.log(plain) for random, plain in zip(*chains, strict=True)]


def _odds(token: Column, ratios: list[float]) -> Column:
    lut = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(lut, acc["last"] * SYMBOLS + s))).alias("sum"))
    return F.aggregate(_symbols(token), zero, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id", ratios: list[float] | None = None, spans: str = "spans") -> DataFrame:
    """Add ``spans``: array of (start, end, rank), rank an index into KINDS, by start, then rank."""
    ratios = ratios if ratios is not None else train(docs, text, id_column)
    # The caller's columns go by number meanwhile, so that their names can't clash with those used here.
    kept = [c for c in docs.columns if c.lower() != spans.lower()]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(kept)), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    body = F.col("__text")
    # Plain substring tests spare most texts the longer patterns.
    lower = F.lower(body)
    named = F.lit(False)
    for word in NAMES:
        named = named | F.contains(lower, F.lit(word))
    none = F.array().cast(SPAN)
    base = F.concat(F.when(named, _matches(body, ASSIGN, 0, 8)).otherwise(none), F.when(F.contains(body, F.lit("AKIA")), _matches(body, ACCESS, 1)).otherwise(none), _matches(body, HEX, 2))
    token = TOKEN % _least_length(ratios)
    words = F.filter(F.array_distinct(F.regexp_extract_all(body, F.lit(token), F.lit(0))), lambda t: _is_random(t, ratios))
    out = fixed(fixed(rows, __base=base, __words=words), __tokens=_matches(body, token, 3, among=F.col("__words")))
    free = lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("__tokens", free)
    found = F.array_sort(F.concat("__base", added), lambda a, b: F.signum((a["start"] - b["start"]) * 8 + (a["rank"] - b["rank"])).cast("int"))
    return fixed(out, __found=found).select(*(F.col(f"u{i}").alias(c) for i, c in enumerate(kept)), F.col("__found").alias(spans))


def _least_length(ratios: list[float]) -> int:
    """Length of the shortest token that can reach LEAST_ODDS."""
    return 1 + max(1, math.ceil(LEAST_ODDS / max(max(ratios), 1e-9)))


def _is_random(token: Column, ratios: list[float]) -> Column:
    odds = _odds(token, ratios)
    return odds >= F.greatest(F.lit(LEAST_ODDS), LEAST_MEAN * (F.length(token) - 1))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span's characters in the text by one mark; overlapping spans share one. Drops the spans."""
    body = F.col(text)
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, (acc["at"] + 1).cast("int"), F.length(body)))
    redacted = F.when(F.size(spans) > 0, F.aggregate(spans, empty, cut, rest)).otherwise(body)
    return docs.withColumn(text, redacted).drop(spans)
