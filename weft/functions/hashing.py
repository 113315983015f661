"""Digests that must match byte for byte, and the hash embedding."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(payload_json: Column) -> Column:
    """Equal for JSON objects with equal content, whatever their key order."""
    return F.sha2(F.to_json(F.try_parse_json(payload_json)), 256)


def exact_content_hash(payload_json: Column) -> Column:
    """SHA-256 of the JSON with sorted keys, separators ", " and ": ", ASCII escapes; null if not JSON."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else hashlib.sha256(json.dumps(json.loads(text), sort_keys=True).encode()).hexdigest()
            except ValueError:
                return None

        return texts.map(one)

    return digest(payload_json)


def hash_embedding(text: Column, dim: int = 768) -> Column:
    """A fixed vector in [-1, 1] from chained SHA-256 blocks: equal texts only are near."""
    seed = F.unhex(F.sha2(text.cast("binary"), 256))
    blocks = F.sequence(F.lit(0), F.lit((dim + 31) // 32 - 1))
    digits = F.transform(blocks, lambda i: F.sha2(F.concat(seed, F.unhex(F.lpad(F.hex(i), 8, "0"))), 256))
    places = F.sequence(F.lit(1), F.lit(2 * dim - 1), F.lit(2))

    def vector(joined: Column) -> Column:
        return F.transform(places, lambda i: ((F.conv(F.substr(joined, i, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5).cast("float"))

    # binding through a one-element array keeps the digests from being made anew for each element
    return F.get(F.transform(F.array(F.array_join(digits, "")), vector), F.lit(0))
