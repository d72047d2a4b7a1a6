"""Spark's xxhash64 of longs, vectorised in NumPy, so that Python stages can re-derive JVM hashes."""

from __future__ import annotations

import numpy as np

# The five primes of the published XXH64 algorithm.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_longs(*columns, seed: int = 42) -> np.ndarray:
    """Equals ``F.xxhash64(*bigint_columns)``: each long is hashed with the hash so far as its seed."""
    with np.errstate(over="ignore"):
        h = np.uint64(seed)
        for column in columns:
            v = np.asarray(column, dtype=np.int64).view(np.uint64)
            x = h + P5 + np.uint64(8)
            x = x ^ (_rotl(v * P2, 31) * P1)
            x = _rotl(x, 27) * P1 + P4
            x = (x ^ (x >> np.uint64(33))) * P2
            x = (x ^ (x >> np.uint64(29))) * P3
            h = x ^ (x >> np.uint64(32))
    return np.asarray(h, dtype=np.uint64).view(np.int64)
