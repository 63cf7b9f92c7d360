r"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

Words are maximal runs of non-space bytes, A-Z in lower case. A document contains an item when some
window of as many words as the item has (the whole document, if shorter) reaches a weighted Jaccard
similarity of 0.8 over five-word shingles, each weighted by its count (fewer than five words: the
whole sequence is one shingle).

Windows: to reach the threshold, a window of m shingles must hold at least ceil(2 t m / (1 + t))
shingles of the benchmark (t m for a shorter document), so windows with fewer are left out; a
bitmap of the benchmark's shingle hashes, whose size is fixed by the benchmark's and checked, tells
which positions can count, with no false negatives, and a table of the item lengths that have a
shingle leaves each position to windows of those lengths alone. Each window gets a 64-bit SimHash of its words.
Two fingerprints within ``RADIUS`` bits agree in one of RADIUS + 1 blocks at least, so an equi-join
on (length, block, bits) finds every pair within the radius; a pair is kept at its first equal block
alone, and its exact similarity is then computed from the words.

Nulls: a null text or item counts as empty and matches nothing; a null id is an id like others. Repeated rows
each get the result of their id; an empty benchmark leaves every document clean, an empty table gives no
rows. Long texts are taken whole; a similarity equal to the limit counts. Other columns pass through
``mark``, and those named like an output (in any case of letters) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = RADIUS + 1
BITS = 64 // BLOCKS
#: Bits of the bitmap for each shingle of the benchmark, and the most 64-bit words it may have (64 MB).
BITMAP_LOAD, MOST_BITMAP_WORDS = 64, 1 << 23
#: Slots of the length table for each shingle of the benchmark, the most slots, and the most (slot, length) pairs it may hold.
LENGTH_LOAD, MOST_SLOTS, MOST_LENGTH_PAIRS = 1, 1 << 16, 1 << 18


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _gram_hashes(v: Column, n: int) -> Column:
    """One hash for each position where n words start, from the words' hashes; none if there are fewer."""
    at = lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(n)))
    return F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(0), F.size(v) - n), at)).otherwise(F.array().cast("array<bigint>"))


def _shingles(w: Column) -> Column:
    at = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(SHINGLE)))
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), at)).otherwise(F.array(F.array_join(w, " ")))


def simhash(w: Column) -> Column:
    """64 bits: each bit the majority of that bit among the words' hashes."""
    ones = lambda b: F.aggregate(w, F.lit(0), lambda n, x: n + F.getbit(F.xxhash64(x), b).cast("int"))
    bit = lambda b: F.when(2 * ones(b) > F.size(w), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _block(print_: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", print_, (b * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1))


def _first_equal_block(a: Column, b: Column) -> Column:
    """The lowest block in which two fingerprints agree."""
    differs = a.bitwiseXOR(b)
    return F.array_position(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: _block(differs, k) == 0), True) - 1


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays, each distinct element weighted by its count."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def _length_table(lengths: DataFrame, count: int):
    """Function from a shingle's hash to the lengths of items that may hold it; collisions add lengths, none is lost.

    ``lengths`` has the benchmark's (h, n); the table's size is checked, and fewer slots are taken beyond it.
    """
    slots = min(MOST_SLOTS, 1 << max(4, (count * LENGTH_LOAD - 1).bit_length()))
    slot = lambda h: F.call_function("shiftrightunsigned", h, F.lit(20)).bitwiseAND(F.lit(slots - 1)).cast("int")
    pairs = lengths.select(slot(F.col("h")).alias("s"), "n").distinct()
    while slots > 1 and pairs.count() > MOST_LENGTH_PAIRS:
        slots //= 16
        pairs = lengths.select(slot(F.col("h")).alias("s"), "n").distinct()
    own: dict[int, list[int]] = {}
    for row in pairs.collect():  # at most MOST_LENGTH_PAIRS
        own.setdefault(row["s"], []).append(row["n"])
    begins, flat = [1], []
    for k in range(slots):
        flat += own.get(k, [])
        begins.append(len(flat) + 1)
    as_array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
    starts, values = as_array(begins), as_array(flat)

    def lengths_of(h: Column) -> Column:
        at, stop = F.get(starts, slot(h)), F.get(starts, slot(h) + 1)
        # Not a slice, which would copy the whole table.
        return F.when(at < stop, F.transform(F.sequence(at, stop - 1), lambda k: F.get(values, k - 1))).otherwise(F.array().cast("array<int>"))

    return lengths_of


def _windows(anchored: DataFrame, id_column: str, lengths_of, gram: int) -> DataFrame:
    """Windows that hold enough positions of items of their length: id, ``__n`` and the words ``__dw``."""
    known = fixed(anchored, __l=F.array_distinct(F.flatten(F.transform("__p", lambda x: lengths_of(x["h"])))))
    fits = (lambda k: k >= SHINGLE) if gram == SHINGLE else (lambda k: k == gram)
    part = known.select(id_column, "__w", F.col("__p").alias("__q"), F.explode(F.filter("__l", fits)).alias("__n"))
    own = F.filter("__q", lambda x: F.array_contains(lengths_of(x["h"]), F.col("__n")))
    part = fixed(part, __p=F.transform(own, lambda x: x["i"])).drop("__q").where(F.size("__p") > 0)
    n, m = F.col("__n"), F.greatest(F.lit(1), F.col("__n") - (SHINGLE - 1))
    # Shingles of the benchmark that a window must hold.
    need = F.ceil(F.lit(2 * SIMILARITY) * m / F.lit(1 + SIMILARITY) - 1e-9).cast("int")
    total = F.size("__w")
    # A window starts at s where so many positions lie in s .. s + m - 1.
    first = lambda i: F.greatest(F.lit(0), F.get("__p", i + need - 1) - m + 1)
    last = lambda i: F.least(F.get("__p", i), total - n)
    begins = F.filter(F.sequence(F.lit(0), F.size("__p") - need), lambda i: (F.get("__p", i + need - 1) - F.get("__p", i) <= m - 1) & (first(i) <= last(i)))
    inside = F.when((total >= n) & (F.size("__p") >= need), F.array_distinct(F.flatten(F.transform(begins, lambda i: F.sequence(first(i), last(i))))))
    whole = F.when((total < n) & (F.size("__p") >= F.ceil(m * SIMILARITY - 1e-9)), F.array(F.lit(0)))
    at = fixed(part, __s=F.coalesce(inside, whole, F.array().cast("array<int>")))
    cut = F.transform("__s", lambda s: F.slice(F.col("__w"), s + 1, F.col("__n")))
    return at.where(F.size("__s") > 0).select(id_column, "__n", F.explode(cut).alias("__dw"))


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (id, item, similarity), one for each document and item it contains, with the best window's similarity."""
    spark = docs.sparkSession
    bench = fixed(items.select(F.col(item_id).alias("__item"), F.col(item_text).alias("__t")), __iw=words(F.col("__t"))).drop("__t").where(F.size("__iw") > 0)
    bench = fixed(bench, __iv=F.transform("__iw", lambda w: F.xxhash64(w)))
    grams = F.coalesce(*(F.when(F.size("__iv") >= n, _gram_hashes(F.col("__iv"), n)) for n in range(SHINGLE, 0, -1)))
    with_lengths = bench.select(F.explode(grams).alias("h"), F.size("__iw").alias("n")).distinct()
    hashed = with_lengths.select("h").distinct()
    facts = bench.agg(F.sort_array(F.collect_set(F.size("__iw"))).alias("lengths")).first()  # as many as distinct lengths
    count = hashed.count()
    empty = docs.select(F.col(id_column), F.lit(None).alias("__item")).where("false").select(id_column, *bench.select("__item").columns, F.lit(0.0).alias("similarity"))
    if not count:
        return empty
    size = 1 << max(6, (count * BITMAP_LOAD // 64 - 1).bit_length())
    if size > MOST_BITMAP_WORDS:
        size = MOST_BITMAP_WORDS  # denser, so that more windows are looked at; no match is lost
    slot = lambda h: F.call_function("shiftrightunsigned", h, F.lit(6)).bitwiseAND(F.lit(size - 1))
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    grid = [0] * size
    probes = hashed.select(F.explode(F.array("h", F.xxhash64("h", F.lit(1)))).alias("h"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("h")))
    # The bits of a word are joined before they come here: one row a word, MOST_BITMAP_WORDS at most.
    for row in probes.groupBy(slot(F.col("h")).cast("int").alias("s")).agg(F.bit_or(one).alias("w")).toLocalIterator():
        grid[row["s"]] = row["w"]
    literal = ",".join(map(str, grid))
    bitmap = F.split(F.lit(literal), ",").cast("array<bigint>")
    probe = lambda h: F.getbit(F.get(bitmap, slot(h).cast("int")), bit(h)) == 1
    marked = lambda h: probe(h) & probe(F.xxhash64(h, F.lit(1)))

    lengths_of = _length_table(with_lengths, count)
    base = fixed(docs.select(F.col(id_column), F.col(text).alias("__t")), __w=words(F.col("__t"))).drop("__t")
    base = fixed(base, __v=F.transform("__w", lambda w: F.xxhash64(w)))
    found = None
    sizes = [(SHINGLE, [n for n in facts["lengths"] if n >= SHINGLE]), *((n, [n]) for n in facts["lengths"] if n < SHINGLE)]
    for gram, own in sizes:
        hashes = fixed(base, __h=_gram_hashes(F.col("__v"), gram))
        positions = F.filter(F.transform("__h", lambda h, i: F.when(marked(h), F.struct(i.alias("i"), h.alias("h")))), lambda x: x.isNotNull())
        # Any window needs one position at least, so documents without can go at once.
        if not own:
            continue
        # No window of any length can match with fewer positions than the shortest whole document needs.
        fewest = min(math.ceil(max(1, n - SHINGLE + 1) * SIMILARITY - 1e-9) for n in own)
        anchored = fixed(hashes, __p=positions).drop("__h", "__v").where(F.size("__p") >= fewest)
        windows = _windows(anchored, id_column, lengths_of, gram)
        found = windows if found is None else found.unionByName(windows)

    key = lambda p: F.explode(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.struct(k.alias("k"), _block(p, k).alias("v"))))
    left = fixed(found.distinct(), __dp=simhash(F.col("__dw"))).select("*", key(F.col("__dp")).alias("__b")).select(id_column, "__n", "__dw", "__dp", F.col("__b.k").alias("__k"), F.col("__b.v").alias("__v"))
    right = fixed(bench, __ip=simhash(F.col("__iw"))).withColumn("__n", F.size("__iw")).select("__item", "__iw", "__ip", "__n", key(F.col("__ip")).alias("__b")).select("__item", "__iw", "__ip", "__n", F.col("__b.k").alias("__k"), F.col("__b.v").alias("__v"))
    near = F.bit_count(F.col("__dp").bitwiseXOR(F.col("__ip"))) <= RADIUS
    pairs = left.join(right, ["__n", "__k", "__v"]).where(near & (_first_equal_block(F.col("__dp"), F.col("__ip")) == F.col("__k")))
    # Computed once a pair: inlined into the join's condition, the shingles would be built anew for every count.
    shingled = fixed(pairs, __a=_shingles(F.col("__dw")), __c=_shingles(F.col("__iw")))
    scored = fixed(shingled, similarity=weighted_similarity(F.col("__a"), F.col("__c"))).where(F.col("similarity") >= SIMILARITY)
    return scored.groupBy(id_column, "__item").agg(F.max("similarity").alias("similarity"))


def mark(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add contaminated, n_items, items (sorted ids) and similarity (the best; null if clean) to every row."""
    found = matches(docs, items, id_column, text, item_id, item_text)
    by_id = found.groupBy(F.col(id_column).alias("__id")).agg(F.sort_array(F.collect_list("__item")).alias("items"), F.max("similarity").alias("similarity"))
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("contaminated", "n_items", "items", "similarity")))
    out = kept.join(by_id, kept[id_column].eqNullSafe(by_id["__id"]), "left").drop("__id")
    none = F.array().cast(dict(by_id.dtypes)["items"])
    return out.withColumns({"contaminated": F.col("items").isNotNull(), "n_items": F.coalesce(F.size("items"), F.lit(0)).cast("long"), "items": F.coalesce("items", none)})
