"""Byte-level BPE by rank files: vectorised pre-tokenisation, cached pair merging and decoding.

Code points become symbols (letter, digit, space, other, apostrophe with what follows it). Each
symbol is a function between a few scanner states; the functions form a small monoid, so their
products are found by table look-ups and prefix products by a two-level scan. A token starts where
the state before a symbol says so, hence no regular expression and no loop over characters.

Nulls count as empty texts and give no ids. Rows keep their order and number, repeated rows too;
other columns pass through, and a column named like an output (in any case of letters) is replaced.
A long text is handled alone, whole; an empty table gives no rows. Between equal pairs the leftmost
is merged first.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ragged, row_chunks, span_hashes, span_words, text_view

# Symbols. LONG: an apostrophe before "re", "ve" or "ll"; SHORT: before s, t, m or d.
LETTER, DIGIT, BLANK, SPACE, OTHER, SHORT, LONG, BEGIN = range(8)
# States: what stands before a code point. FORCED: a token starts here in any case; EAT1, EAT2: one or two letters of a contraction follow.
FORCED, S_LETTER, S_DIGIT, S_BLANK, S_SPACE, S_OTHER, EAT1, EAT2 = range(8)
#: Words cached in a worker; the cache is emptied beyond that.
CACHE_WORDS = 400_000
#: Longest slice that is cached and merged in a matrix.
MATRIX_LENGTH = 32
_NONE = np.int32(2**31 - 1)


def _step(state: int, symbol: int) -> int:
    if symbol == BEGIN:
        return FORCED
    if state == EAT2:
        return EAT1
    if state == EAT1:
        return FORCED
    if symbol in (SHORT, LONG):
        if state in (S_BLANK, S_OTHER):
            return S_OTHER
        return EAT1 if symbol == SHORT else EAT2
    return {LETTER: S_LETTER, DIGIT: S_DIGIT, BLANK: S_BLANK, SPACE: S_SPACE, OTHER: S_OTHER}[symbol]


@lru_cache(maxsize=1)
def scanner() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product table, functions as rows of states) of the transition monoid."""
    functions = [tuple(range(8))]
    index = {functions[0]: 0}
    generators = []
    for symbol in range(8):
        f = tuple(_step(s, symbol) for s in range(8))
        if f not in index:
            index[f] = len(functions)
            functions.append(f)
        generators.append(index[f])
    at = 0
    while at < len(functions):
        for g in generators:
            h = tuple(functions[g][s] for s in functions[at])
            if h not in index:
                index[h] = len(functions)
                functions.append(h)
        at += 1
    n = len(functions)
    product = np.zeros((n, n), np.uint16)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            product[i, j] = index[tuple(g[s] for s in f)]
    return np.array(generators, np.uint16), product, np.array(functions, np.uint8)


def states_before(symbols: np.ndarray, block: int = 64) -> np.ndarray:
    """The scanner's state before each symbol, by a scan over products of transition functions."""
    generators, product, functions = scanner()
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint16)  # 0 is the identity
    padded[:n] = generators[symbols]
    lanes = np.ascontiguousarray(padded.reshape(rows, block).T)
    whole = lanes[0].copy()
    for k in range(1, block):
        whole = product[whole, lanes[k]]
    span = 1
    while span < rows:  # inclusive products over blocks
        whole[span:] = product[whole[:-span].copy(), whole[span:]]
        span *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = functions[whole[:-1], FORCED]
    out = np.empty((block, rows), np.uint8)
    for k in range(block):
        out[k] = state
        state = functions[lanes[k], state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


@lru_cache(maxsize=1)
def _code_point_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            classes[cp] = LETTER if kind == "L" else DIGIT
    # Code points with the White_Space property.
    for lo, hi in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        classes[lo : hi + 1] = SPACE
    classes[0x20] = BLANK
    return classes


def slice_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the slices of ``public_tokenizers.PATTERN`` start in texts ``points[at[i]:at[i + 1]]``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _code_point_classes()[points]
    filled = at[:-1] < at[1:]
    begins, ends = at[:-1][filled], at[1:][filled] - 1
    last = np.zeros(n, bool)
    last[ends] = True
    symbols = kinds.copy()
    quote = np.flatnonzero((points == 0x27) & ~last)
    if len(quote):
        one = points[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        symbols[quote[short]] = SHORT
        rest = quote[~short & ~last[quote + 1]]
        one, two = points[rest + 1], points[np.minimum(rest + 2, n - 1)]
        e, v, l, r = (ord(c) for c in "evlr")
        symbols[rest[((two == e) & ((one == r) | (one == v))) | ((one == l) & (two == l))]] = LONG
    # A text's start resets the state: its reset stands as a symbol of its own before it.
    shifted = np.arange(n) + np.repeat(np.arange(1, len(begins) + 1), np.diff(np.append(begins, n)))
    stream = np.full(n + len(begins), BEGIN, np.uint8)
    stream[shifted] = symbols
    before = states_before(stream)[shifted]
    white = kinds == BLANK
    white |= kinds == SPACE
    next_white = np.zeros(n, bool)
    next_white[:-1] = white[1:]
    next_white[last] = True  # no code point that isn't white follows
    was_white = (before == S_BLANK) | (before == S_SPACE)
    same = ((before == S_LETTER) & (kinds == LETTER)) | ((before == S_DIGIT) & (kinds == DIGIT)) | ((before == S_OTHER) & (kinds == OTHER))
    joins = np.where(white, was_white & next_white, same | (before == S_BLANK)) | (before == EAT1) | (before == EAT2)
    joins &= before != FORCED
    return np.flatnonzero(~joins)


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one slice of each text, the place in it of every slice). Slices are told apart by hashes, and the bytes of those with equal hashes are compared."""
    _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    owner = first[inverse]
    same = ends - starts == (ends - starts)[owner]
    for at, word in span_words(data, starts, ends, MATRIX_LENGTH):
        words = np.zeros(len(starts), np.uint64)
        words[at] = word
        same &= words == words[owner]
    raw = data.tobytes()
    for i in np.flatnonzero(same & (ends - starts > MATRIX_LENGTH) & (owner != np.arange(len(starts)))).tolist():
        same[i] = raw[starts[i] : ends[i]] == raw[starts[owner[i]] : ends[owner[i]]]
    if not same.all():
        seen: dict[bytes, int] = {}
        inverse = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        _, first = np.unique(inverse, return_index=True)
    return first, inverse


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        self.ranks = {}
        with open(path, "rb") as file:
            for line in file:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pair_codes = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[c] for c in self.pair_codes.tolist()], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        both = self.byte_ids.astype(np.int64)
        self.byte_pairs = self._rank(np.repeat(both, 256), np.tile(both, 256)).reshape(256, 256)
        self.decimal = np.zeros((self.size, len(str(self.size)) + 1), np.uint8)
        for i in range(self.size):
            text = f"{i} ".encode()
            self.decimal[i, : len(text)] = np.frombuffer(text, np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where((self.pair_codes[at] == code) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NONE)

    def merge_one(self, piece: bytes) -> np.ndarray:
        """Ids of one long slice: pairs in a heap, neighbours in linked lists."""
        import heapq

        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = dict(zip(self.pair_codes.tolist(), self.pair_ranks.tolist(), strict=True)) if not hasattr(self, "_known") else self._known
        self._known = known
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := known.get(ids[i] * self.size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := known.get(ids[left] * self.size + ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge_many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Ids (as int32 bytes) of short slices of ``data``, merging one pair in every row of a matrix at a time."""
        out: list[bytes] = [b""] * len(starts)
        order = np.argsort(lengths, kind="stable")
        for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 20), (20, MATRIX_LENGTH)):
            rows = order[(lengths[order] > lo) & (lengths[order] <= hi)]
            if not len(rows):
                continue
            columns = np.arange(hi)
            inside = columns < lengths[rows][:, None]
            raw = data[np.minimum(starts[rows][:, None] + columns, len(data) - 1)]
            ids = np.where(inside, self.byte_ids[raw], -1)
            ranks = np.full((len(rows), hi), _NONE, np.int32)
            ranks[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1], raw[:, 1:]], _NONE)
            active = np.arange(len(rows))
            while len(active):
                work = ranks[active]
                j = work.argmin(axis=1)
                best = work[np.arange(len(active)), j]
                going = best != _NONE
                active, j, best, work = active[going], j[going], best[going], work[going]
                if not len(active):
                    break
                source = np.minimum(columns + (columns > j[:, None]), hi - 1)
                now = np.take_along_axis(ids[active], source, axis=1)
                work = np.take_along_axis(work, source, axis=1)
                now[:, -1] = -1
                work[:, -1] = _NONE
                at = np.arange(len(active))
                now[at, j] = best
                left, right = np.maximum(j - 1, 0), np.minimum(j + 1, hi - 1)
                work[at, left] = np.where(j > 0, self._rank(now[at, left], best), work[at, left])
                work[at, j] = np.where(j + 1 < hi, self._rank(best, now[at, right]), _NONE)
                ids[active], ranks[active] = now, work
            flat = ids.astype(np.int32)
            counts = (flat >= 0).sum(axis=1)
            packed = flat[flat >= 0].tobytes()
            ends = np.cumsum(counts) * 4
            for row, end, count in zip(rows.tolist(), ends.tolist(), counts.tolist(), strict=True):
                out[row] = packed[end - 4 * count : end]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids before each row, byte offset of each id in its text) of a string column."""
        data, at = text_view(column)
        lead = (data & 0xC0) != 0x80
        point_bytes = np.flatnonzero(lead)
        points_before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=points_before[1:])
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = point_bytes[slice_starts(points, points_before[at])]
        lengths = np.diff(np.append(starts, len(data)))
        row_of = np.searchsorted(at, starts, side="right") - 1
        unique, inverse = distinct_slices(data, starts, starts + lengths)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        raw = data.tobytes()
        names = [raw[a:b] for a, b in zip(starts[unique].tolist(), (starts + lengths)[unique].tolist(), strict=True)]
        found = [self.cache.get(k) for k in names]
        long = lengths[unique] > MATRIX_LENGTH
        new = np.array([i for i, x in enumerate(found) if x is None and not long[i]], np.int64)
        for i, ids in zip(new.tolist(), self.merge_many(data, starts[unique[new]], lengths[unique[new]]), strict=True):
            found[i] = self.cache[names[i]] = ids
        for i in np.flatnonzero(long).tolist():
            found[i] = self.merge_one(names[i]).tobytes()
        flat = np.frombuffer(b"".join(found), np.int32)
        counts = np.array([len(x) for x in found], np.int64) // 4
        begins = np.cumsum(counts) - counts
        per = counts[inverse]
        ids = flat[ragged(begins[inverse], per)]
        before = np.zeros(len(at), np.int64)
        np.cumsum(np.bincount(row_of, weights=per, minlength=len(at) - 1).astype(np.int64), out=before[1:])
        sizes = self.lengths[ids]
        offsets = np.cumsum(sizes) - sizes - np.repeat(at[:-1], np.diff(before))
        return ids, before, offsets

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        rows = self.decimal[ids]
        return rows[rows > 0].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _schema(df: DataFrame, fields: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Add ``ids`` (array<int>) and ``offsets`` (array<long>: the byte where each id starts). The text column must not be named like an output."""
    path = path or default_path()
    keep, schema = _schema(df, [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(offsets, T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo, hi in row_chunks(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                flat, before, at = c.encode(part.column(text))
                own = [pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(x)) for x in (flat, at)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *own], names=[*keep, ids, offsets])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the ids; null ids give null, unknown ids raise."""
    path = path or default_path()
    keep, schema = _schema(df, [T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.binary())], names=[*keep, decoded])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode in one pass, adding n_tokens and the digests of ids and of decoded bytes."""
    path = path or default_path()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    keep, schema = _schema(df, fields)
    keep = [k for k in keep if k != text]
    schema = T.StructType([f for f in schema.fields if f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo, hi in row_chunks(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                flat, before, _ = c.encode(part.column(text))
                own = [[], []]
                for i in range(hi - lo):
                    ids = flat[before[i] : before[i + 1]]
                    own[0].append(hashlib.sha256(c.decimals(ids)).hexdigest())
                    own[1].append(hashlib.sha256(c.decode(ids.tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(np.diff(before)), *(pa.array(x, pa.string()) for x in own)], names=[*keep, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)
