"""Quality rules: word and line counts, and tokeniser fertility with rejection bands per script.

Fertility comes from public vocabularies: code points per token and entropy of the tokens of a
byte-level vocabulary, and the share of code points for which a piece vocabulary falls back to
bytes. A document outside its script's band is rejected. ``fit_bands`` takes the bands from the tails
of all documents labelled good, at exact ranks; scripts with too few of these keep the wide ``BANDS``,
which only reject what hardly is text. ``measure`` takes a text's counts and measures once, for the fit
(``bands_of``) and for the verdict (``with_verdict``). A null text counts as empty: no words, so the base rule rejects it. Rows keep
their number, repeated rows get equal results; the text is dropped, other columns pass through, and a
column named like an output (in any case of letters) is replaced. Texts are taken whole, a long one
alone; a value on a band's edge is inside; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import byte_bpe
from .common import mix, row_chunks, shared_checkpoint, span_hashes, text_view, word_spans

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Scripts and their code point ranges.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
#: Rows that a script's band needs; tails cut off at both ends, and the part of the rest's width that is added outside.
LEAST_ROWS, TAIL, MARGIN = 50, 0.001, 0.1
#: Columns that bands bound, and the bits of a value that a pass over them tells apart.
MEASURES, DIGIT = ("chars_per_token", "fallback_share", "token_entropy"), 12
#: Least and most code points a token, most share of byte fallback, least bits of token entropy: wide ones, where none are fitted.
BANDS = {
    "latin": (1.3, 12.0, 0.20, 2.5),
    "greek": (0.4, 8.0, 0.30, 2.5),
    "cyrillic": (0.4, 8.0, 0.30, 2.5),
    "han": (0.3, 4.0, 0.70, 2.5),
    "kana": (0.3, 4.0, 0.70, 2.5),
    "hangul": (0.3, 4.0, 0.90, 2.5),
    "none": (0.9, 12.0, 0.50, 2.0),
}
OTHER_BAND = (0.3, 8.0, 0.90, 2.5)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _covered(path: str) -> np.ndarray:
    """Which code points are pieces of their own; others are spelt in bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = np.zeros(0x110000, bool)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if len(piece) == 1:
            known[ord(piece)] = True
    known[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return known


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    lut = np.zeros(0x110000, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            lut[lo : hi + 1] = i
    return lut


def _sum_by(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64 if weights is None or weights.dtype.kind in "iub" else np.float64)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    data, at = text_view(column)
    n = len(column)
    row_of_byte = lambda where: np.searchsorted(at, where, side="right") - 1
    starts, ends, rows = word_spans(data, at)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    out = {"n_words": _sum_by(rows, n), "word_chars": _sum_by(rows, n, points[ends] - points[starts])}
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    out["n_symbols"] = _sum_by(row_of_byte(np.flatnonzero(is_symbol[data])), n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    owners = np.concatenate([np.arange(n), row_of_byte(breaks)])
    order = np.argsort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    line_rows = owners[order]
    line_ends = np.append(line_starts[1:], len(data))
    same = np.append(line_rows[1:] == line_rows[:-1], False)
    line_ends = np.where(same, line_ends - 1, at[line_rows + 1])
    first_word = np.searchsorted(starts, line_starts)
    wordy = first_word < np.searchsorted(starts, line_ends)
    lines = span_hashes(data, line_starts[wordy], line_ends[wordy])
    owners = line_rows[wordy]
    _, firsts = np.unique(mix(lines + owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out["n_dup_lines"] = _sum_by(owners, n) - _sum_by(owners[firsts], n)

    words = span_hashes(data, starts, ends)
    repeated = np.zeros(len(words), bool)
    if len(words) >= WINDOW:
        count = len(words) - WINDOW + 1
        windows = rows[:count].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            windows = (windows ^ words[k : k + count]) * np.uint64(0xD1342543DE82EF95)
            windows ^= windows >> np.uint64(29)
        whole = np.flatnonzero(rows[:count] == rows[WINDOW - 1 :])
        _, inverse, counts = np.unique(windows[whole], return_inverse=True, return_counts=True)
        twice = whole[counts[inverse] > 1]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, twice, 1)
        np.add.at(change, twice + WINDOW, -1)
        repeated = np.cumsum(change[:-1]) > 0
    out["n_repeat_words"] = _sum_by(rows[repeated], n)
    return out


def fertility(column: pa.Array, ranks: str, pieces: str) -> dict[str, np.ndarray]:
    """chars_per_token, fallback_share, token_entropy and script (an index) of each row; 0 without text."""
    codec = byte_bpe.codec(ranks)
    ids, before, _ = codec.encode(column)
    n = len(column)
    tokens = np.diff(before)
    data, at = text_view(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    ends = lead[at]
    chars = np.diff(ends)
    rows = np.repeat(np.arange(n), chars)
    fallback = _sum_by(rows[~_covered(pieces)[points]], n)
    scripts = np.zeros((n, len(SCRIPTS) + 1), np.int64)
    kinds = _scripts()[points].astype(np.int64)
    np.add.at(scripts.reshape(-1), *np.unique(rows * (len(SCRIPTS) + 1) + kinds, return_counts=True)) if len(points) else None
    scripts[:, 0] = 0
    owner = np.repeat(np.arange(n), tokens)
    keys, counts = np.unique(owner * codec.size + ids, return_counts=True)
    spread = np.bincount(keys // codec.size, weights=counts * np.log2(counts), minlength=n) if len(keys) else np.zeros(n)
    some = np.maximum(tokens, 1)
    return {
        "chars_per_token": chars / some,
        "fallback_share": fallback / np.maximum(chars, 1),
        "token_entropy": np.where(tokens > 0, np.log2(some) - spread / some, 0.0),
        "script": np.where(scripts.max(axis=1) > 0, scripts.argmax(axis=1), 0),
    }


def ranked_values(df: DataFrame, wanted: dict[tuple[str, str], set[int]], group: str = "script") -> dict[tuple[str, str, int], float]:
    """The values at 0-based ranks: {(group, column): ranks} to {(group, column, rank): value}, exact for any number of rows.

    A radix selection: each pass counts the next ``DIGIT`` bits of the values that share the bits found
    so far, so that no task sorts or holds a group's values.
    """
    state = {(g, c, r): (0, r) for (g, c), ranks in wanted.items() for r in ranks}  # bits found, rank among the values that share them
    done = 0
    while state and done < 64:
        step = min(DIGIT, 64 - done)
        below = 64 - done - step
        open_bits: dict[tuple[str, str], set[int]] = {}
        for (g, c, _), (found, _) in state.items():
            open_bits.setdefault((g, c), set()).add(found)
        targets = [(i, g, c, sorted(found)) for i, ((g, c), found) in enumerate(open_bits.items())]

        def run(batches: Iterator[pa.RecordBatch], targets=targets, done=done, step=step, below=below) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owners = np.array(batch.column(group).to_pylist(), object)
                for i, g, c, found in targets:
                    bits = batch.column(c).to_numpy()[owners == g].view(np.int64)
                    bits = (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)  # in the values' order
                    tops = bits >> np.uint64(below)
                    if done:
                        tops = tops[np.isin(tops >> np.uint64(step), np.array(found, np.uint64))]
                    keys, counts = np.unique(tops, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["target", "bits", "n"])

        sums = df.select(group, *MEASURES).mapInArrow(run, "target int, bits long, n long").groupBy("target", "bits").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** DIGIT rows a group, column and bits found
        which, keys, counts = (sums.column(k).to_numpy() for k in range(3))
        keys = keys.view(np.uint64)
        at = {(g, c): i for i, g, c, _ in targets}
        for (g, c, r), (found, rank) in list(state.items()):
            mine = (which == at[g, c]) & ((keys >> np.uint64(step)) == np.uint64(found) if done else True)
            order = np.argsort(keys[mine])
            upto = np.cumsum(counts[mine][order])
            k = int(np.searchsorted(upto, rank, side="right"))
            state[g, c, r] = (int(keys[mine][order][k]), rank - (int(upto[k - 1]) if k else 0))
        done += step
    out = {}
    for key, (found, _) in state.items():
        bits = np.array([found ^ (1 << 63)], np.uint64).view(np.int64)
        out[key] = float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])
    return out


def bands_of(measured: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality") -> dict[str, tuple]:
    """Bands of each script from all rows of ``measure`` that are labelled good (1) and pass the base rule."""
    good = labels.where((F.col(label) == 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id")).distinct()
    rows = measured.where(~F.col("base_failed")).select(F.col(id_column).alias("__id"), "script", *MEASURES).join(good, "__id").select("script", *MEASURES)
    rows = shared_checkpoint(rows)
    sizes = {r["script"]: r["n"] for r in rows.groupBy("script").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).collect()}  # one row a script
    places = {g: ((n - 1) * TAIL, (n - 1) * (1 - TAIL)) for g, n in sizes.items()}
    around = lambda p: (int(np.floor(p)), int(np.ceil(p)))
    values = ranked_values(rows, {(g, c): {k for p in places[g] for k in around(p)} for g in sizes for c in MEASURES})

    def ends(g: str, c: str) -> list[float]:
        found = []
        for p in places[g]:
            lo, hi = around(p)
            found.append(values[g, c, lo] if lo == hi else (hi - p) * values[g, c, lo] + (p - lo) * values[g, c, hi])
        return found

    out = dict(BANDS)
    for g in sizes:
        (a, b), (c, d), (e, f) = (ends(g, m) for m in MEASURES)
        out[g] = (a - MARGIN * (b - a), b + MARGIN * (b - a), d + max(0.02, MARGIN * (d - c)), e - MARGIN * (f - e))
    return out


def fit_bands(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", ranks: str | None = None, pieces: str | None = None) -> dict[str, tuple]:
    """Bands of each script from all documents labelled good (1) that pass the base rule."""
    return bands_of(measure(df.select(id_column, text), text, ranks, pieces), labels, id_column, label)


def measure(df: DataFrame, text: str = "text", ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """Replace the text by the counts, base_failed and the measures behind the verdict."""
    ranks, pieces = ranks or byte_bpe.default_path(), pieces or default_pieces()
    names = ["none", *SCRIPTS]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [*(T.StructField(k, T.LongType()) for k in longs), T.StructField("base_failed", T.BooleanType()), *(T.StructField(k, T.DoubleType()) for k in MEASURES), T.StructField("script", T.StringType())]
    own = [f.name for f in fields]
    passed = [f for f in df.schema.fields if f.name != text and f.name.lower() not in (*own, "kept")]
    keep = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_chunks(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                x = base_counts(part.column(text))
                y = fertility(part.column(text), ranks, pieces)
                failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
                values = [*(pa.array(x[k]) for k in longs), pa.array(failed), *(pa.array(y[k]) for k in MEASURES), pa.array([names[k] for k in y["script"].tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *values], names=[*keep, *own])

    return df.mapInArrow(run, T.StructType([*passed, *fields]))


def with_verdict(measured: DataFrame, bands: dict[str, tuple]) -> DataFrame:
    """Add kept to rows of ``measure``: the base rule and the script's band hold."""
    limits = [[F.lit(float(x)) for x in bands.get(k, OTHER_BAND)] for k in ("none", *SCRIPTS)]
    inside = F.lit(False)
    for script, (least, most, share, bits) in zip(("none", *SCRIPTS), limits, strict=True):
        holds = F.col("chars_per_token").between(least, most) & (F.col("fallback_share") <= share) & (F.col("token_entropy") >= bits)
        inside = F.when(F.col("script") == script, holds).otherwise(inside)
    names = measured.columns
    at = names.index("base_failed") + 1
    return measured.select(*(F.col(f"`{c}`") for c in names[:at]), (inside & ~F.col("base_failed")).alias("kept"), *names[at:])


def quality_rules(df: DataFrame, text: str = "text", ranks: str | None = None, pieces: str | None = None, bands: dict[str, tuple] | None = None) -> DataFrame:
    """Replace the text by the counts, base_failed, kept, and the measures behind the verdict."""
    return with_verdict(measure(df, text, ranks, pieces), BANDS if bands is None else bands)
