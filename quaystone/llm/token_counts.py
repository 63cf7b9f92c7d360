"""Token counts by a tokenizer file, without keeping tokens.

Texts are cut at ASCII white space, which the tokenizer drops and never joins across, so the parts'
counts add up to the whole text's count however long it is. Equal words are encoded once for each
cache; batches hold about the same number of bytes whatever their number of rows.

A null text counts as empty: 0 bytes, 0 tokens. Rows keep their number, repeated rows too; other columns
than the text pass through, and a column named like an output (in any case of letters) is replaced. A long
text is counted whole; a count equal to the limit is not over it; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import row_chunks, text_view

#: Words cached in a worker; the cache is emptied beyond that.
CACHE_WORDS = 500_000
#: Longest word that is cached, in bytes.
CACHED_BYTES = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _counter(path: str) -> tuple[Callable[[list[bytes]], list[int]], dict[bytes, int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)], {}
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda words: [len(e) for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)], {}


def count_words(words: list[bytes], path: str) -> dict[bytes, int]:
    """The counts of at least these words."""
    encode, cache = _counter(path)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = list(set(words).difference(cache))
    found = {}
    for at in range(0, len(new), 4096):
        part = new[at : at + 4096]
        found.update(zip(part, encode(part), strict=True))
    # Long words are rare and would fill the cache with bytes.
    cache.update((w, n) for w, n in found.items() if len(w) <= CACHED_BYTES)
    return cache | found if len(found) and max(map(len, found)) > CACHED_BYTES else cache


def token_counts(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """Replace the text by n_bytes, n_tokens and over_limit (n_tokens > limit).

    A ``path`` ending in .json is for tokenizers that drop white space, as the default does; one ending in .model is
    a piece model, which joins across white space and so gets whole texts.
    """
    path = path or default_path()
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name != text and f.name.lower() not in names]
    whole = path.endswith(".model")
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_chunks(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                data, at = text_view(part.column(text))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if whole:
                    counts = np.array(_counter(path)[0](texts), np.int64)
                else:
                    rows = [t.split() for t in texts]
                    known = count_words([w for row in rows for w in row], path)
                    counts = np.array([sum(map(known.__getitem__, row)) for row in rows], np.int64)
                own = [pa.array(np.diff(at)), pa.array(counts), pa.array(counts > limit)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *own], names=[*keep, *names])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))
