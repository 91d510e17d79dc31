"""Hashes by which keys are routed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of MurmurHash3 (x86, 32 bits), and the seed that routing uses.
SEED = 0x9747B28C
_C1, _C2, _ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
_MIX1, _MIX2 = 0x85EBCA6B, 0xC2B2AE35


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3(keys: list[bytes], seed: int = SEED) -> np.ndarray:
    """MurmurHash3 of byte strings: all of them advance one word at a time, those that have ended stand still."""
    n = np.array([len(k) for k in keys], np.int64)
    width = int(n.max(initial=0) + 4) // 4 * 4
    cells = np.zeros((len(keys), max(width, 4)), np.uint8)
    cells[np.arange(cells.shape[1])[None, :] < n[:, None]] = np.frombuffer(b"".join(keys), np.uint8)
    words = cells.view("<u4")
    h = np.full(len(keys), seed, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(words.shape[1]):
            k = _rotate(words[:, i] * np.uint32(_C1), 15) * np.uint32(_C2)
            whole, tail = (i + 1) * 4 <= n, (i * 4 < n) & (n < (i + 1) * 4)
            h = np.where(whole, _rotate(h ^ k, 13) * np.uint32(5) + np.uint32(_ADD), np.where(tail, h ^ k, h))
        h ^= n.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(_MIX1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(_MIX2)
    return h ^ (h >> np.uint32(16))


def _murmur3_positive(keys: pd.Series) -> pd.Series:
    hashed = murmur3([(k or "").encode() for k in keys]) & np.uint32(0x7FFFFFFF)
    return pd.Series(hashed.astype(np.int32))


def murmur3_positive(key: Column) -> Column:
    """MurmurHash3 of the UTF-8 bytes without the sign bit."""
    return F.pandas_udf(_murmur3_positive, "int")(key)


def crc32_positive(key: Column) -> Column:
    """CRC-32 of the UTF-8 bytes without the sign bit."""
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def sha256_int(key: Column) -> Column:
    """The first four bytes of SHA-256 as a little-endian signed integer, without its sign."""
    h = F.sha2(key.cast("binary"), 256)
    little = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    unsigned = F.conv(little, 16, 10).cast("long")
    return F.abs(F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned))
