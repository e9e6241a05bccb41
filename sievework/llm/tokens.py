"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of ranks; read on the executors, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the byte-level vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return count


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of each row; a null text has none. Whole texts are encoded, no shuffle."""
    d = docs.select(*keep, F.col(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(_counter(vocabulary), f"{kinds}, n_tokens long")
