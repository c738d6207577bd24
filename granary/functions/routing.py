"""Key routing: a 64-bit FNV-1a hash of a key and its placement among buckets.

Text hashes its UTF-8 octets, integers their eight little-endian octets; reals
and null can't be routed. The hash wraps at 64 bits, which ANSI arithmetic
forbids, so columns are hashed in Arrow batches with numpy's unsigned numbers;
plain Python is used for single keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a.
OFFSET = 0xCBF29CE484222325
PRIME = 0x100000001B3
MASK = (1 << 64) - 1


def key_octets(key: str | int) -> bytes:
    if isinstance(key, str):
        return key.encode()
    if isinstance(key, int) and not isinstance(key, bool):
        return key.to_bytes(8, "little", signed=True)
    raise ValueError("only text and integer keys can be routed")


def hash_key(key: str | int) -> int:
    """Unsigned hash of one key."""
    value = OFFSET
    for octet in key_octets(key):
        value = (value ^ octet) * PRIME & MASK
    return value


def hash_octets(octets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned hashes of the rows of a matrix of octets, each of its own length."""
    value = np.full(len(lengths), OFFSET, np.uint64)
    for j in range(octets.shape[1]):
        longer = lengths > j
        value[longer] = (value[longer] ^ octets[longer, j]) * np.uint64(PRIME)
    return value


def hash_series(keys: pd.Series) -> np.ndarray:
    """Unsigned hashes of a series of integers or of texts without nulls."""
    if pd.api.types.is_integer_dtype(keys.dtype):
        octets = keys.to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8)
        return hash_octets(octets, np.full(len(keys), 8))
    raw = [k.encode() for k in keys]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.empty(len(raw), np.uint64)
    order = np.argsort(lengths, kind="stable")  # rows of like length share a matrix, so one long key widens only its own
    for part in np.array_split(order, max(1, len(order) // 1024)):
        width = int(lengths[part].max()) if len(part) else 0
        octets = np.zeros((len(part), max(1, width)), np.uint8)
        for row, i in enumerate(part):
            octets[row, : lengths[i]] = np.frombuffer(raw[i], np.uint8)
        out[part] = hash_octets(octets, lengths[part])
    return out


def modulo(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes % np.uint64(n)).astype(np.int64)


def linear(hashes: np.ndarray, level: int, split: int) -> np.ndarray:
    """Bucket under linear hashing: 2**level buckets, of which those below ``split`` are split already."""
    low = hashes & np.uint64((1 << level) - 1)
    wide = hashes & np.uint64((1 << (level + 1)) - 1)
    return np.where(low < split, wide, low).astype(np.int64)


@dataclass(frozen=True)
class Modulo:
    """hash % buckets."""

    buckets: int

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return modulo(hashes, self.buckets)


@dataclass(frozen=True)
class Linear:
    """Linear hashing; growing by one bucket moves keys of one bucket only."""

    level: int
    split: int = 0

    @property
    def buckets(self) -> int:
        return (1 << self.level) + self.split

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return linear(hashes, self.level, self.split)

    def grown(self) -> Linear:
        return Linear(self.level + 1, 0) if self.split + 1 == 1 << self.level else Linear(self.level, self.split + 1)


def _udf(finish, kind: str):
    """An Arrow UDF over keys that passes nulls through."""

    @F.pandas_udf(kind)
    def run(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series([None] * len(keys), dtype="object")
        some = keys[known]
        if len(some):
            some = some.astype(np.int64) if pd.api.types.is_numeric_dtype(some.dtype) else some
            out[known.to_numpy()] = finish(hash_series(some))
        return out

    return run


def _routable(key: Column, spark_type: str) -> Column:
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return key.cast("long")
    if spark_type == "string":
        return key
    raise ValueError(f"a key of type {spark_type} can't be routed")


def hash_column(key: Column, spark_type: str) -> Column:
    """The hash as a signed long (the same 64 bits)."""
    return _udf(lambda h: h.view(np.int64), "long")(_routable(key, spark_type))


def bucket_column(key: Column, spark_type: str, routing: Modulo | Linear) -> Column:
    return _udf(routing.place, "long")(_routable(key, spark_type))
