"""What the operators share: reading tables, text columns as bytes, ASCII words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_UPPER = bytes(range(65, 91))
#: Lower-cases A-Z and nothing else.
ASCII_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list:
    """A string column's values as UTF-8 bytes; None stays."""
    return column.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, U64), np.full(n - 1, U64(0x9E3779B97F4A7C15)))), dtype=U64)


def powers(n: int) -> np.ndarray:
    """Odd multipliers for at least n places of a word."""
    return _powers(1 << max(6, (n - 1).bit_length()))


class Keys:
    """Places of 64-bit hashes in a sorted array of distinct ones, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length())
        self.shift = U64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32)
        self.starts = np.append(self.starts, np.int32(len(keys)))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is absent."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(wanted), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, wanted = at[todo], end[todo], wanted[todo]
        while len(todo):
            hit = self.keys[at] == wanted
            out[todo[hit]] = at[hit]
            at = at + 1
            left = ~hit & (at < end)
            todo, at, end, wanted = todo[left], at[left], end[left], wanted[left]
        return out
