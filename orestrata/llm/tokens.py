"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is read where it lies; its path is a parameter and must be
readable on every executor.
"""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that belongs to the byte-level vocabularies.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = BYTE_PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = DEFAULT_VOCABULARY) -> int:
    return len(_encoding(path).encode_ordinary(text))


def with_sizes(df: DataFrame, keys: list[str], text_column: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The keys and ``tokens`` of every row; null and empty texts have 0."""
    base = df.select(*keys, F.col(text_column).alias("__text"))
    last = len(keys)

    def run(batches):
        encoding = _encoding(path)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(sizes, pa.int64())], names=[*keys, "tokens"])

    schema = df.select(*keys).schema.add("tokens", "long")
    return base.mapInArrow(run, schema)
