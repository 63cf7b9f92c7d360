"""Near duplicates by SetSketch registers: band, estimate by likelihood, verify on full sets.

A document's set holds the distinct shingles of its words (A-Z in lower case); shorter documents
have their whole sequence as the one shingle, documents without words have an empty set and link
with nothing. Equal sets form one class. Each class has ``REGISTERS`` SetSketch registers: the
minimum of an exponential variate over the set, on a scale spaced by powers of ``BASE`` and
truncated to 16 bits, so registers of a union are the larger of both and equal registers tell
similar sets. Bands of ``BAND`` registers give buckets; at similarity 0.85 a pair misses all of them
with probability 5e-7 (at 0.8: 5e-5).

Buckets are never expanded to all pairs. In rounds, each class of a bucket meets the bucket's hub alone:
the class that shares buckets with most others, as the text does from which a group of copies was edited.
Links found so far give components; the classes outside the hub's component form the bucket's rest and
get a hub of their own in the next round, while a round still takes in an eighth of them or more.

What is left is decided by differences. If D(x) holds the shingles in which x and the hub differ, x and
y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles; for a link with an x that isn't linked to the hub,
D(x) and D(y) must share some, and how many follows from sizes. So among the members of a hub, sorted from the
rarest difference to the commonest, x and y must have equal ones within known prefixes: an equi-join on these,
filtered by position and size, gives all such links and hardly any other pair. The join is made between
the rest and the hub's component in each round, and inside the rest of the last round; pairs in one component can't
change anything.

Candidates go on if the similarity that maximises the joint likelihood of greater, smaller and equal
registers is within five deviations of the limit, and are confirmed on the full sets. Components come
from large and small stars in turn.

A null text counts as empty. Rows with a null id link with nothing. Repeated rows each get the
result of their text, also where an id has several. Sets hold 64-bit hashes of shingles. Texts are taken whole, however long; among equal sets the
smallest id stands for the class. An empty table gives no rows; columns other than the id are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, lowered, mix, row_chunks, shared_checkpoint, span_hashes, text_view, word_spans

REGISTERS, BAND = 125, 5
BASE, LARGEST = 1.001, 65534
#: Rows of one bucket that a task should meet at the most, about.
SALT_ROWS = 20_000
#: Hash products computed at once for the registers.
BLOCK = 1 << 16


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, at = text_view(column)
    starts, ends, rows = word_spans(data, at)
    words = span_hashes(lowered(data), starts, ends)
    first = np.searchsorted(rows, np.arange(len(column) + 1))
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)] + np.uint64(k + 1))
    out = []
    for i in range(len(column)):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            out.append(np.frombuffer(hashlib.blake2b(words[lo:hi].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(words[:0])
    return out


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (seeds[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[REGISTERS:] >> np.uint64(32)).astype(np.uint32)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of 64-bit hashes."""
    a, c = _factors()
    low = (elements >> np.uint64(32)).astype(np.uint32) ^ elements.astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    step = max(1, BLOCK // REGISTERS)
    for i in range(0, len(low), step):
        part = low[i : i + step]
        h = np.multiply.outer(a, part)
        h += c[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)  # minimum of exponential variates
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def estimate(greater: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sets of n and m elements that maximises the joint likelihood of the register counts."""
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    grid = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    up, down = p(np.clip(u - v * grid, 0, 1)), p(np.clip(v - u * grid, 0, 1))
    equal = np.clip(1 - up - down, 1e-12, 1)
    g, s = greater[:, None], smaller[:, None]
    likelihood = g * np.log(up) + s * np.log(down) + (REGISTERS - g - s) * np.log(equal)
    return np.take_along_axis(grid, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(docs: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """id, n_shingles, set_key (binary, null for an empty set) and sketch of every row."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column(1), size)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                own = [registers(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.binary())], names=["id", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n_shingles long, set_key binary, sketch binary")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) whose estimated similarity is within five deviations of the limit."""
    side = lambda x: classes.select(F.col("set_key").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    deviation = 5 * np.sqrt(least * (1 - least) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
                n, m = (batch.column(k).to_numpy().astype(float) for k in (4, 5))
                likely = estimate((x > y).sum(axis=1), (x < y).sum(axis=1), n, m) >= least - deviation
                likely &= np.minimum(n, m) >= least * np.maximum(n, m)
                yield batch.select(["a", "b"]).filter(pa.array(likely))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    return joined.mapInArrow(run, "a binary, b binary")


def _sets(needed: DataFrame, docs: DataFrame, classes: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """The full sets (k, e) of the needed classes (set_key), one row each, made again from the texts."""
    rows = classes.join(needed, "set_key", "left_semi").select(F.col("id").alias("__rep"))
    texts = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("t")).join(rows, F.col("__id") == F.col("__rep"), "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_chunks(batch.column(0)):
                sets = [s for s in shingle_sets(batch.column(0).slice(lo, hi - lo), size) if len(s)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["k", "e"])

    return shared_checkpoint(texts.mapInArrow(run, "k binary, e array<long>").dropDuplicates(["k"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the limit on full sets."""
    side = lambda x: sets.select(F.col("k").alias(x), F.col("e").alias(f"e{x}"))
    shared = F.size(F.array_intersect("ea", "eb"))
    enough = 100 * shared.cast("long") >= percent * (F.size("ea") + F.size("eb") - shared)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node but the smallest of its component, which is the label.

    Large stars and small stars in turn: every node's greater neighbours, then its smaller ones, are linked to the
    smallest of them, until nothing moves. No step has more edges than the one before it, and minima are
    taken before the shuffle, so a hub with very many links is no burden.
    """
    edges = shared_checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved"))
        edges = shared_checkpoint(small)
        if edges.where("moved").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).distinct()


def _by_band(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (band, n, set_key, ...) with the one row (band, size of the band, ...) of their band; a band of many rows is dealt to several tasks."""
    parts = F.sequence(F.lit(0), (F.col("band_rows") / SALT_ROWS).cast("int"))
    dealt = own.withColumn("__salt", F.explode(parts)).drop("band_rows")
    salt = F.pmod(F.xxhash64("set_key"), 1 + (F.col("n") / SALT_ROWS).cast("int")).cast("int")
    return rows.withColumn("__salt", salt).join(dealt, ["band", "__salt"]).drop("__salt")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add a node's label, which is itself where it has no link."""
    own = labels.select(F.col("node").alias(node), F.col("label").alias(name))
    return rows.join(own, node, "left").withColumn(name, F.coalesce(name, node))


def _outside(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members outside the component of their band's hub, in bands that have several of them: band, n, set_key, size, partners."""
    hubs = members.groupBy("band").agg(F.first("hub").alias("hub"), F.max("n").alias("band_rows"))
    main = _labelled(hubs, labels, "hub", "main").select("band", "band_rows", "main")
    rest = _by_band(_labelled(members, labels, "set_key", "mine"), main).where("mine <> main").select("band", "set_key", "size", "partners")
    counts = rest.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return rest.join(counts, "band").select("band", "n", "set_key", "size", "partners")


def _by_differences(rounds: list[DataFrame], labels: DataFrame, everyone: tuple, percent: int) -> tuple[DataFrame, DataFrame] | None:
    """Candidates (a, b) in different components among members of one hub, and the sets of those members; None where there are none."""
    group = ["level", "hub"]
    rows = None
    for level, members in enumerate(rounds):
        own = members.select(F.lit(level).alias("level"), "hub", "set_key", F.col("size").alias("nx")).distinct()
        rows = own if rows is None else rows.union(own)
    # A hub's label is looked up once a hub, not once a member.
    hubs = _labelled(rows.select(*group).distinct(), labels, "hub", "main")
    rows = _labelled(rows, labels, "set_key", "mine").join(hubs, group)
    rows = shared_checkpoint(rows.select(*group, "set_key", "nx", "mine", (F.col("mine") == F.col("main")).alias("inside"), (F.col("level") == len(rounds) - 1).alias("last")))
    # A hub's members need looking at if one of them is outside and has another one than the hub to meet.
    outside = F.sum(F.when(~F.col("inside"), 1).otherwise(0))
    counts = rows.groupBy(*group).agg(outside.alias("o"), F.count("*").alias("n"), F.first("last").alias("final"))
    open_ = counts.where("o > 0 and n > 2 and (final or n - o > 1)").select(*group)
    rows = shared_checkpoint(rows.join(open_, group, "left_semi"))
    if rows.isEmpty():
        return None
    needed = rows.select("set_key").union(rows.select("hub"))
    sets = _sets(needed, *everyone)
    both = rows.where("set_key <> hub").join(sets.select(F.col("k").alias("set_key"), F.col("e").alias("ex")), "set_key").join(sets.select(F.col("k").alias("hub"), F.col("e").alias("eh")), "hub")
    facts = F.struct("nx", F.size("eh").alias("nh"), "mine", "inside", "last")
    differences = F.concat(F.array_except("ex", "eh"), F.array_except("eh", "ex"))
    single = both.select(*group, "set_key", facts.alias("facts"), differences.alias("d")).select(*group, "set_key", "facts", F.size("d").alias("nd"), F.explode("d").alias("e"))
    single = shared_checkpoint(single)
    # Differences of one member alone come first in its order and can't be equal to another's; only their number counts.
    common = single.groupBy(*group, "e").agg(F.count("*").alias("often")).where("often > 1")
    ordered = single.join(common, [*group, "e"]).groupBy(*group, "set_key").agg(F.first("facts").alias("f"), F.first("nd").alias("nd"), F.sort_array(F.collect_list(F.struct("often", "e"))).alias("s"))
    places = ordered.select(*group, "set_key", "f.*", "nd", F.size("s").alias("ns"), F.posexplode("s").alias("at", "x")).select(*group, "set_key", "nx", "nh", "mine", "inside", "last", "nd", F.col("x.e").alias("e"), (F.col("nd") - F.col("ns") + F.col("at")).alias("at"))
    # The most shingles in which a link may differ, for the largest partner that x can have; and x's prefix against members that the hub's limit leaves outside.
    most = f"floor((100 - {percent}) * (nx + floor(100 * nx / {percent})) / (100 + {percent}))"
    places = places.where(f"at <= {most}").withColumn("half", F.expr(f"2 * {100 + percent} * at <= {100 + percent} * nd + {100 - percent} * (nx - nh)"))
    places = shared_checkpoint(places.where("half or not inside"))
    x = places.where("not inside").select(*group, "e", *(F.col(c).alias(f"x_{c}") for c in ("set_key", "nx", "mine", "nd", "at")))
    y = places.where("half and (inside or last)").select(*group, "e", *(F.col(c).alias(f"y_{c}") for c in ("set_key", "nx", "mine", "nd", "at", "inside")))
    fits = F.expr(f"x_mine <> y_mine and (y_inside or x_set_key < y_set_key) and 100 * least(x_nx, y_nx) >= {percent} * greatest(x_nx, y_nx)")
    # Shingles that the differences of a link must share.
    share = f"((x_nd + y_nd - floor({100 - percent} * (x_nx + y_nx) / {100 + percent}) + 1) div 2)"
    near = F.expr(f"x_at <= x_nd - {share} and y_at <= y_nd - {share}")
    found = x.join(y, [*group, "e"]).where(fits & near)
    return shared_checkpoint(found.select(F.least("x_set_key", "y_set_key").alias("a"), F.greatest("x_set_key", "y_set_key").alias("b")).distinct()), sets


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable), kept (id is its component)."""
    spark = docs.sparkSession
    base = shared_checkpoint(sketches(docs, id_column, text, size))
    some = base.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    classes = shared_checkpoint(some.groupBy("set_key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda k: F.xxhash64(k, F.substr(F.col("sketch"), (k * (2 * BAND) + 1).cast("int"), F.lit(2 * BAND))))
    entries = classes.select("set_key", F.col("n_shingles").alias("size"), F.explode(bands).alias("band"))
    counted = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared_checkpoint(entries.join(counted, "band"))
    partners = shared.groupBy("set_key").agg(F.sum("n").alias("partners"))
    rest = shared.join(partners, "set_key").select("band", "n", "set_key", "size", "partners")
    least = percent / 100
    everyone = (docs, classes, id_column, text, size)

    labels, rounds = None, []
    while True:
        best = rest.groupBy("band").agg(F.max(F.struct("partners", "set_key")).alias("best"), F.max("n").alias("band_rows")).select("band", "band_rows", F.col("best.set_key").alias("hub"))
        members = shared_checkpoint(_by_band(rest, best).select("band", "n", "hub", "set_key", "size", "partners"))
        rounds.append(members)
        star = members.where("hub <> set_key").select(F.col("hub").alias("a"), F.col("set_key").alias("b")).distinct()
        likely = shared_checkpoint(_likely(star, classes, least))
        needed = likely.select(F.col("a").alias("set_key")).union(likely.select("b"))
        links = shared_checkpoint(_confirmed(likely, _sets(needed, *everyone), percent))
        known = links if labels is None else links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = shared_checkpoint(components(known))
        rest = shared_checkpoint(_outside(members, labels))
        free_shuffles(spark)
        left = rest.select("set_key").distinct().count()
        if not left or 8 * links.count() < left:
            break

    cross = _by_differences(rounds, labels, everyone, percent)
    if cross is not None:
        pairs, sets = cross
        links = _confirmed(shared_checkpoint(_likely(pairs, classes, least)), sets, percent)
        labels = components(links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    # The smallest id of each component with several classes; only these are few.
    linked = shared_checkpoint(labels.union(labels.select("label", "label")).distinct().join(classes.select(F.col("set_key").alias("node"), "id"), "node"))
    least_ids = linked.groupBy("label").agg(F.min("id").alias("component_id"))
    reached = classes.select("set_key", "id").join(linked.join(least_ids, "label").select(F.col("node").alias("set_key"), "component_id"), "set_key", "left").select("set_key", F.coalesce("component_id", "id").alias("component_id"))
    result = base.join(reached, "set_key", "left").select("id", "n_shingles", F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id"))
    return result.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
