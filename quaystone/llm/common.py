"""Helpers shared by the text operators: table access, row keys, Arrow text views and word hashes."""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: The bytes between words in the contracts' ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Longest span in bytes that is hashed word by word.
SHORT_SPAN = 64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's reader alone, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only where driver and executors are one process, a temporary folder will do if it is unset.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quaystone-checkpoints-"))
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that a checkpoint has made unreachable: it does so when the driver's JVM collects them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    lut = np.ones(256, bool)
    lut[list(SPACES)] = False
    return lut


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; a longer row stands alone."""
    _, at = text_view(column)
    start, n = 0, len(column)
    while start < n:
        stop = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield start, stop
        start = stop


def word_spans(buffer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (a maximal run of non-space bytes; rows separate words)."""
    if not len(buffer):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _is_word()[buffer]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = inside[begins]
    ends = at[1:][at[:-1] < at[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, side="right") - 1


def lowered(buffer: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer + np.uint8(32), buffer).astype(np.uint8)


def span_words(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = SHORT_SPAN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The spans' bytes as 64-bit words, ``most`` bytes of each at the most: (spans that reach so far, their next word)."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(buffer) + 1, "<u8", padded.data, strides=(1,))
    alive = np.flatnonzero(ends > starts)
    for step in range(0, most, 8):
        alive = alive[ends[alive] - starts[alive] > step]
        if not len(alive):
            return
        left = np.minimum(ends[alive] - starts[alive] - step, 8).astype(np.uint64)
        yield alive, at_byte[starts[alive] + step] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand.

    Short spans are mixed word by word, which is no polynomial; longer ones get a BLAKE2 digest.
    """
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _M2 + _BASE)
    for at, word in span_words(buffer, starts, ends):
        out[at] = mix((out[at] ^ word) * _BASE)
    for i in np.flatnonzero(lengths > SHORT_SPAN).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(buffer[starts[i] : ends[i]].data, digest_size=8).digest(), np.uint64)[0]
    return out


def gram_hashes(buffer: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes (a multiple of 8) that start at each position."""
    count = len(buffer) - size + 1
    at_byte = np.ndarray(len(buffer) - 7, "<u8", np.ascontiguousarray(buffer).data, strides=(1,))
    out = np.full(count, _BASE, np.uint64)
    for step in range(0, size, 8):
        out ^= at_byte[step : step + count]
        out *= _M1
        out ^= out >> _S33
    return out * _M2


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def with_copy_number(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "copy_no") -> DataFrame:
    """Number the rows of a repeated key (by text), 0 for the others; costs no shuffle of texts where keys are unique."""
    repeated = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("__key"))
    if repeated.isEmpty():
        return df.withColumn(name, F.lit(0))
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first())
    return df.withColumn(name, F.row_number().over(by) - 1)


def fixed(df: DataFrame, **columns) -> DataFrame:
    """Add columns that the optimiser computes once a row: a generator's output is never put into later expressions, lambdas or filters in place of its name."""
    for name, value in columns.items():
        df = df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
    return df
