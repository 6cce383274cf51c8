"""What the corpus operators share: reading, bounded sums over tables, hashing of bytes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: words are runs of anything but these.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key written as text, modulo ``buckets``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets))


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows, the same ones on every run: those with the smallest hashed keys."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(rows)


# --- numpy ----------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240131)
_BYTE = (_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64; kept for the next call."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _POWERS[base] = out
    return _POWERS[base][:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word in a byte array."""
    inside = np.concatenate(([False], ~_IS_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of a polynomial over random byte values."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=np.uint64, out=total[1:])
        back = powers(_INVERSE, len(data) + 1)
        return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def batches_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; a larger row is a range of its own."""
    start = size = 0
    for at, n in enumerate(sizes):
        if at > start and size + n > limit:
            yield start, at
            start, size = at, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
