"""Removal of repeated 100-byte strings by a distributed merge sort of suffixes.

Texts are UTF-8 bytes. A byte goes if a string of ``WINDOW`` bytes covers it that also starts earlier:
in a smaller id, or earlier in the same document. Strings never cross documents and are judged on
the input.

Suffixes: each window's anchor is the smallest hash among its ``GRAM``-byte strings, the leftmost of
equal ones, so equal windows have their anchors at the same place, and only about one position in 35
is an anchor. Anchors whose gram stands once in the corpus can't be in a repeat and go first, by an
exact count. For the others the suffix of the anchor, followed by the reversed bytes before it,
decides everything. Each task sorts its suffixes to a run, keeps the earliest of equal ones (the
others are covered, which is told at once), and sends runs front-coded: the length of the prefix
shared with the suffix before and the bytes that differ. A loser tree merges the runs of a range of
grams. It keeps for every run the prefix length it shares with the last suffix put out: the longer
one is the smaller suffix, and bytes are compared only behind equal lengths, so a known prefix is
never compared again. Among the merged suffixes, those equal in all bytes are covered by the
earliest; where only the gram is shared, every window of the anchors is held against the earlier
ones by its hash.

A null text counts as empty. Rows that repeat an id count as separate documents, ordered by their
text. Null ids are ordered before all others. Documents shorter than a window lose nothing; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gram_hashes, mix, ragged, row_chunks, text_view, with_copy_number

WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM  # bytes of a window that may stand before its anchor
SUFFIX = WINDOW + REACH
OUTSIDE = 0xFF  # stands for bytes beyond a document's ends; never in UTF-8
#: Bytes of text for each range of grams.
RANGE_BYTES = 16 << 20
#: Members whose windows are hashed at once.
MEMBERS = 20_000
_RECORD = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("at", "<i8"), ("low", "u1"), ("high", "u1"), ("shared", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("start", "<i8"), ("end", "<i8")])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position in data, row, gram hash, least and most bytes of its windows before it) of each anchor."""
    windows = np.maximum(np.diff(at) - WINDOW + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none
    places = np.arange(len(data) - GRAM + 1)
    hashes = gram_hashes(data, GRAM)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    span = 1
    while span * 2 <= REACH + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < REACH + 1:
        rest = REACH + 1 - span
        least = np.minimum(least[:-rest], least[rest:])
    starts = ragged(at[:-1], windows)
    rows = np.repeat(np.arange(len(windows)), windows)
    own = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(own)) - 1
    place = own[first]
    return place, rows[first], hashes[place], place - starts[last], place - starts[first]


def suffixes(data: np.ndarray, at: np.ndarray, place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A matrix of suffixes: the window's bytes from the anchor on, then the bytes before it, backwards."""
    steps = np.concatenate([np.arange(WINDOW), -np.arange(1, REACH + 1)])
    out = np.empty((len(place), SUFFIX), np.uint8)
    for lo in range(0, len(place), 50_000):
        where = place[lo : lo + 50_000, None] + steps
        inside = (where >= at[row[lo : lo + 50_000], None]) & (where < at[row[lo : lo + 50_000] + 1, None])
        out[lo : lo + 50_000] = np.where(inside, data[np.clip(where, 0, len(data) - 1)], OUTSIDE)
    return out


def _covered(records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), _SPAN)
    out["doc"], out["copy"] = records["doc"], records["copy"]
    out["start"], out["end"] = records["at"] - records["high"], records["at"] - records["low"] + WINDOW
    return out


def run_blob(strings: np.ndarray, records: np.ndarray) -> bytes:
    """A front-coded run of suffixes, and the spans of those that equal an earlier one of the run."""
    order = np.lexsort((records["at"], records["copy"], records["doc"]))
    keys = np.ascontiguousarray(strings[order]).view(f"S{SUFFIX}").ravel()
    order = order[np.argsort(keys, kind="stable")]
    strings, records = strings[order], records[order].copy()
    differs = strings[1:] != strings[:-1]
    shared = np.zeros(len(strings), np.int64)
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), SUFFIX)
    kept = shared < SUFFIX
    spans = _covered(records[~kept])
    strings, records, shared = strings[kept], records[kept], shared[kept]
    records["shared"] = shared
    rest = strings[np.arange(SUFFIX) >= shared[:, None]]
    return zstandard.compress(struct.pack("<qq", len(records), len(spans)) + records.tobytes() + spans.tobytes() + rest.tobytes(), 3)


class Run:
    """A reader of a front-coded run."""

    def __init__(self, blob: bytes):
        blob = zstandard.decompress(blob)
        n, m = struct.unpack_from("<qq", blob)
        self.records = np.frombuffer(blob, _RECORD, n, 16)
        self.spans = np.frombuffer(blob, _SPAN, m, 16 + n * _RECORD.itemsize)
        self.blob, self.next_byte = blob, 16 + n * _RECORD.itemsize + m * _SPAN.itemsize
        self.shared = self.records["shared"].tolist()
        self.at, self.now = -1, b""

    def step(self) -> int:
        """Go to the next suffix; the length it shares with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= len(self.shared):
            return -1
        shared = self.shared[self.at]
        end = self.next_byte + SUFFIX - shared
        self.now = self.now[:shared] + self.blob[self.next_byte : end]
        self.next_byte = end
        return shared


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two suffixes that share ``start`` bytes."""
    if a == b:
        return SUFFIX
    lo, hi = start, SUFFIX
    while hi - lo > 8:
        middle = (lo + hi) // 2
        if a[lo:middle] == b[lo:middle]:
            lo = middle
        else:
            hi = middle
    while a[lo] == b[lo]:
        lo += 1
    return lo


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, index in it, length shared with the suffix before, suffix), in order, by a loser tree."""
    n = 1
    while n < len(runs):
        n *= 2
    # A player is (shared with the last suffix put out, run); a run at its end shares -1.
    shared = [-1] * n
    for i, run in enumerate(runs):
        shared[i] = min(run.step(), 0)
    losers = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length is then against the winner."""
        x, y = shared[a], shared[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        s, t = runs[a].now, runs[b].now
        k = _common(s, t, x)
        if k == SUFFIX or s[k] < t[k]:
            shared[b] = k
            return a, b
        shared[a] = k
        return b, a

    winners = [0] * (2 * n)
    for i in range(n):
        winners[n + i] = i
    for i in range(n - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1] if n > 1 else 0
    while shared[top] >= 0:
        run = runs[top]
        yield top, run.at, shared[top], run.now
        shared[top] = run.step()
        node = (top + n) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _window_spans(strings: np.ndarray, records: np.ndarray) -> np.ndarray:
    """Spans of the windows, around anchors of shared grams, that equal an earlier window."""
    order = np.lexsort((records["at"], records["copy"], records["doc"]))
    strings, records = strings[order], records[order]
    text = np.concatenate([strings[:, : WINDOW - 1 : -1], strings[:, :WINDOW]], axis=1)
    offsets = np.arange(REACH + 1)
    begins = REACH - offsets
    # The hash of a window from those of its first, middle and last bytes; WINDOW is no more than two halves and a rest.
    grams = gram_hashes(np.ascontiguousarray(text).reshape(-1), GRAM)
    at = np.arange(len(text))[:, None] * SUFFIX + begins
    hashes = offsets.astype(np.uint64) + np.uint64(1)
    for step in (*range(0, WINDOW - GRAM, GRAM), WINDOW - GRAM):
        hashes = mix(hashes ^ grams[at + step])
    valid = (offsets >= records["low"][:, None]) & (offsets <= records["high"][:, None])
    flat = np.flatnonzero(valid)
    _, first = np.unique(hashes.reshape(-1)[flat], return_index=True)
    twice = np.ones(len(flat), bool)
    twice[first] = False
    hit = np.zeros(valid.size, bool)
    hit[flat[twice]] = True
    hit = hit.reshape(valid.shape)
    edge = np.zeros((len(hit), REACH + 3), np.int8)
    edge[:, 1:-1] = hit
    member, low = np.nonzero(np.diff(edge, axis=1) == 1)
    _, high = np.nonzero(np.diff(edge, axis=1) == -1)
    out = np.zeros(len(member), _SPAN)
    out["doc"], out["copy"] = records["doc"][member], records["copy"][member]
    out["start"], out["end"] = records["at"][member] - (high - 1), records["at"][member] - low + WINDOW
    return out


def merged_spans(blobs: list[bytes]) -> Iterator[np.ndarray]:
    """Covered spans from the runs of one range of grams."""
    runs = [Run(b) for b in blobs]
    for run in runs:
        if len(run.spans):
            yield run.spans
    strings: list[bytes] = []
    records: list[np.void] = []
    group_start, equal, covered = 0, 0, []

    def flush(upto: int) -> Iterator[np.ndarray]:
        if upto:
            matrix = np.frombuffer(b"".join(strings[:upto]), np.uint8).reshape(-1, SUFFIX)
            yield _window_spans(matrix, np.array(records[:upto], _RECORD))
            del strings[:upto], records[:upto]

    for run, index, shared, suffix in merge(runs):
        record = runs[run].records[index]
        if shared < GRAM and strings:
            if len(strings) - group_start == 1:  # a gram of one suffix
                strings.pop()
                records.pop()
            group_start = len(strings)
            if group_start >= MEMBERS:
                yield from flush(group_start)
                group_start = 0
        if shared == SUFFIX:
            kept = records[equal]
            if (record["doc"], record["copy"], record["at"]) < (kept["doc"], kept["copy"], kept["at"]):
                record, records[equal] = kept, record
            covered.append(record)
            if len(covered) >= MEMBERS:
                yield _covered(np.array(covered, _RECORD))
                covered = []
            continue
        strings.append(suffix)
        records.append(record)
        equal = len(records) - 1
    if covered:
        yield _covered(np.array(covered, _RECORD))
    yield from flush(len(strings))


def removed_spans(docs: DataFrame, parts: int) -> DataFrame:
    """Covered spans (doc, copy, start, end in bytes) of docs (id, doc, copy, t).

    The join takes all four columns, as the one in ``remove_repeats`` does, so that both read one exchange of the texts.
    """

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_chunks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                _, row, gram, _, _ = anchors(*text_view(part.column(2)))
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(gram.view(np.int64))], names=["doc", "copy", "gram"])

    grams = docs.select("doc", "copy", "t").mapInArrow(grams_of, "doc long, copy int, gram long")
    shared = grams.withColumn("n", F.count("*").over(Window.partitionBy("gram"))).where("n > 1")
    # Dealt by doc alone: where no id is repeated, copy is a constant and the join asks for no more, so it needs no second exchange.
    wanted = shared.repartition("doc").groupBy("doc", "copy").agg(F.collect_set("gram").alias("grams"))
    both = docs.join(wanted, ["doc", "copy"]).select("doc", "copy", "t", "grams", "id")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list] = {}
            for lo, hi in row_chunks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                data, at = text_view(part.column(2))
                place, row, gram, low, high = anchors(data, at)
                lists = part.column(3)
                owners = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                salt = lambda g, r: mix(g ^ (r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                known = np.isin(salt(gram, row), salt(lists.flatten().to_numpy().view(np.uint64), owners))
                place, row, gram, low, high = place[known], row[known], gram[known], low[known], high[known]
                records = np.zeros(len(place), _RECORD)
                records["doc"] = part.column(0).to_numpy()[row]
                records["copy"] = part.column(1).to_numpy()[row]
                records["at"], records["low"], records["high"] = place - at[row], low, high
                strings = suffixes(data, at, place, row)
                to = (gram % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(parts + 1))
                for p in np.unique(to).tolist():
                    own = order[cuts[p] : cuts[p + 1]]
                    held.setdefault(p, []).append((strings[own], records[own]))
            names = sorted(held)
            blobs = [run_blob(np.concatenate([s for s, _ in held[p]]), np.concatenate([r for _, r in held[p]])) for p in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

    def merge_part(part: pa.Table) -> pa.Table:
        found = list(merged_spans(part.column("run").to_pylist()))
        spans = np.concatenate(found) if found else np.zeros(0, _SPAN)
        return pa.table([pa.array(np.ascontiguousarray(spans[k])) for k in _SPAN.names], names=list(_SPAN.names))

    runs = both.mapInArrow(runs_of, "part int, run binary")
    return runs.groupBy("part").applyInArrow(merge_part, "doc long, copy int, start long, end long")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes)."""
    if parts is None:
        # As many ranges of grams as the texts need, so that one task's runs stay bounded.
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
        parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    numbered = with_copy_number(base.withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))), "doc", "t", "copy")
    spans = removed_spans(numbered.select("id", "doc", "copy", "t"), parts)
    packed = spans.repartition("doc").groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = numbered.select("id", "doc", "copy", "t").join(packed, ["doc", "copy"], "left").select("id", "t", F.col("spans.start").alias("s"), F.col("spans.end").alias("e"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                data, at = text_view(part.column(1))
                raw = data.tobytes()
                out: list[list] = [[], [], [], []]
                for i in range(hi - lo):
                    whole = raw[at[i] : at[i + 1]]
                    kept, runs, gone = whole, 0, 0
                    if part.column(2)[i].is_valid:
                        change = np.zeros(len(whole) + 1, np.int64)
                        np.add.at(change, part.column(2)[i].values.to_numpy(), 1)
                        np.add.at(change, part.column(3)[i].values.to_numpy(), -1)
                        dropped = np.cumsum(change[:-1]) > 0
                        gone = int(dropped.sum())
                        runs = int(dropped[0]) + int((dropped[1:] & ~dropped[:-1]).sum())
                        kept = np.frombuffer(whole, np.uint8)[~dropped].tobytes()
                    for column, value in zip(out, (len(whole), gone, runs, hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)[id_column]
    result = both.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return result.withColumnRenamed("id", id_column)
