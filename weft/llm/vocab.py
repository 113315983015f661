"""Byte-level BPE vocabularies from public rank files, read on the driver and shared with tasks."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import SparkSession

#: Where the box keeps public vocabulary files; a parameter of every operator that tokenizes.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_BYTES = 64 << 20


def shared(spark: SparkSession, path: str = RANKS) -> object:
    """The rank file for all tasks; its size does not follow the data and is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{path} has more than {MAX_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


@lru_cache(maxsize=1)
def encoding(data: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder, and the number of bytes of each token id; built once in a worker."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("weft", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
