"""Word splitting and hashing shared by the text operators.

A word is ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes, which is what
``bytes.split()`` yields: only ASCII white space separates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
import xxhash

#: Java and Spark regular expression of the separators.
GAPS = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LONG = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(_LONG, _BASE, dtype=np.uint64), dtype=np.uint64)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _FOLD
    x ^= x >> np.uint64(32)
    x *= _FOLD
    x ^= x >> np.uint64(32)
    return x


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where each word starts and ends."""
    arr = np.frombuffer(data, dtype=np.uint8)
    if not len(arr):
        none = np.empty(0, dtype=np.int64)
        return arr, none, none
    edge = np.flatnonzero(np.diff(_SPACE[arr].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return arr, edge[0::2], edge[1::2]


def hash_words(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of ``data``, in order."""
    arr, starts, ends = bounds(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lens = ends - starts
    body = arr[~_SPACE[arr]].astype(np.uint64)
    first = np.cumsum(lens) - lens
    at = np.arange(len(body)) - np.repeat(first, lens)
    long = lens > _LONG
    if long.any():
        at = np.minimum(at, _LONG - 1)
    sums = np.add.reduceat((body + np.uint64(1)) * _POWERS[at], first)
    out = mix64(sums + lens.astype(np.uint64))
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], 7)
    return out


def roll(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= _BASE
        acc += words[j : j + n]
    return mix64(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_HIGH = 0x0080808080808080
_LOW = 0x007F7F7F7F7F7F7F
_ONES = 0x0001010101010101


def within(a: Column, b: Column, radius: int) -> Column:
    """True if no packed coordinate differs by more than ``radius``."""
    gap = a.bitwiseOR(F.lit(_HIGH)) - b + F.lit(radius * _ONES)
    at_least = gap.bitwiseAND(F.lit(_HIGH)) == F.lit(_HIGH)
    at_most = (gap.bitwiseAND(F.lit(_LOW)) + F.lit((127 - 2 * radius) * _ONES)).bitwiseAND(F.lit(_HIGH)) == F.lit(0)
    return at_least & at_most
