"""CRC-32C by combination.

Without its first and last inversion a CRC is linear: that of two strings joined
is the first one's, moved past the second's bytes, xor the second one's, and
moving past n bytes is a product with x**(8 n) modulo the polynomial. So strings
are summed up in pairs, in as many steps as their length has bits, and the CRC
of a volume is an xor over its blocks in any order, which Spark adds up map-side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the polynomial, bits reversed.
POLY = 0x82F63B78
ONES = np.uint32(0xFFFFFFFF)
#: x to this power is 1, so bytes can be moved back too.
ORDER = (1 << 31) - 1
#: Strings summed up at once, in bytes.
BATCH = 1 << 23


def _byte_tables() -> np.ndarray:
    """[k][b]: the value of byte b with k zero bytes after it."""
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (POLY if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> 8) ^ t[0, t[k - 1] & 255]
    return t


_AFTER = _byte_tables()


def _table(columns: np.ndarray) -> np.ndarray:
    """[k][b]: a linear map, given by what it makes of each of the 32 bits, for each value of each byte."""
    t = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            t[k, np.arange(256) >> bit & 1 > 0] ^= columns[8 * k + bit]
    return t


def _apply(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    return t[0, v & 255] ^ t[1, v >> 8 & 255] ^ t[2, v >> 16 & 255] ^ t[3, v >> 24]


def _moves() -> list[np.ndarray]:
    """Tables that move a value past 2**i bits, i below 34: each is the one before, twice."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = (bits >> np.uint32(1)) ^ np.where(bits & 1, np.uint32(POLY), np.uint32(0))
    out = [_table(step)]
    for _ in range(33):
        step = _apply(out[-1], step)
        out.append(_table(step))
    return out


_MOVE = _moves()


def moved(values: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each value with so many zero bytes after it, or taken off if negative."""
    out, n = values.astype(np.uint32), (n_bytes.astype(np.int64) % ORDER) * 8 % ORDER
    for i in range(31):
        on = (n >> i & 1) > 0
        if on.any():
            out[on] = _apply(_MOVE[i], out[on])
    return out


def combine(a, b, b_bytes) -> np.ndarray:
    """CRC-32C of a string from those of its two parts and the length of the second."""
    return moved(np.atleast_1d(np.asarray(a, np.uint32)), np.atleast_1d(np.asarray(b_bytes))) ^ np.asarray(b, np.uint32)


def _plain(blobs: list) -> np.ndarray:
    """Of each blob the value without inversions: zero bytes in front change nothing, so each is filled up to whole words of eight, and words are joined in pairs until there is one for each blob."""
    lens = np.array([len(b) for b in blobs], np.int64)
    n = -(-lens // 8)
    ends = np.cumsum(n)
    buf = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, np.uint8)
    for b, size, end in zip(blobs, lens.tolist(), (ends * 8).tolist(), strict=True):
        buf[end - size : end] = np.frombuffer(b, np.uint8)
    words = buf.reshape(-1, 8)
    value = np.zeros(len(words), np.uint32)
    for k in range(8):
        value ^= _AFTER[7 - k][words[:, k]]
    level = 6  # 2**6 bits in a word
    while len(n) and n.max() > 1:
        half = -(-n // 2)
        first, start = np.cumsum(half) - half, np.cumsum(n) - n
        blob = np.repeat(np.arange(len(n)), half)
        right = start[blob] + 2 * (np.arange(len(blob)) - first[blob]) + 1 - (n % 2)[blob]  # of an odd number the first stands alone
        left = right - 1
        alone = left < start[blob]
        value = np.where(alone, 0, _apply(_MOVE[level], value[np.maximum(left, 0)])).astype(np.uint32) ^ value[right]
        n, level = half, level + 1
    out = np.zeros(len(lens), np.uint32)
    out[lens > 0] = value
    return out


def crc32c_many(blobs: list) -> np.ndarray:
    """CRC-32C of all blobs, a few megabytes at a time."""
    lens = np.array([len(b) for b in blobs], np.int64)
    plain, lo, held = [], 0, 0
    for i, size in enumerate(lens.tolist()):
        held += size
        if held >= BATCH or i == len(lens) - 1:
            plain.append(_plain(blobs[lo : i + 1]))
            lo, held = i + 1, 0
    value = np.concatenate(plain) if plain else np.zeros(0, np.uint32)
    return (value ^ moved(np.full(len(lens), ONES), lens) ^ ONES).astype(np.int64)


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of a binary column, unsigned; null of null."""
    there = data.notna()
    out = pd.Series([None] * len(data), dtype="Int64")
    out[there.to_numpy()] = crc32c_many(data[there].tolist())
    return out


@F.pandas_udf(T.LongType())
def _back(crc: pd.Series, length: pd.Series, end: pd.Series) -> pd.Series:
    """What a block adds to its volume's value, all bytes up to its end taken off."""
    n = length.to_numpy(np.int64)
    plain = crc.to_numpy(np.int64).astype(np.uint32) ^ ONES ^ moved(np.full(len(n), ONES), n)
    return pd.Series(moved(plain, -end.to_numpy(np.int64)).astype(np.int64))


@F.pandas_udf(T.LongType())
def _whole(value: pd.Series, size: pd.Series) -> pd.Series:
    n = size.to_numpy(np.int64)
    return pd.Series((moved(value.to_numpy(np.int64).astype(np.uint32), n) ^ moved(np.full(len(n), ONES), n) ^ ONES).astype(np.int64))


def combined(blocks: DataFrame, by: list[str], offset: str = "offset", length: str = "length", crc: str = "crc32c") -> DataFrame:
    """(by, size, crc32c): CRC-32C of each volume from those of its blocks (by, offset, length, crc), in any order and at any cuts, without their bytes.

    One aggregate: each block's value has the bytes up to its own end taken off,
    values are xored map-side and in the shuffle, and each volume's bytes are put
    on again. Blocks must cover a volume from 0 without gaps or overlaps: where
    their lengths don't add up to its size, the CRC is null. Blocks without bytes
    or with nulls change nothing.
    """
    b = blocks.where(F.col(length) > 0).where(F.col(crc).isNotNull() & F.col(offset).isNotNull())
    end = (F.col(offset) + F.col(length)).cast("long")
    b = b.select(*by, F.col(length).cast("long").alias("n_"), end.alias("e_"), _back(F.col(crc).cast("long"), F.col(length).cast("long"), end).alias("v_"))
    got = b.groupBy(*by).agg(F.max("e_").alias("size"), F.sum("n_").alias("n_"), F.bit_xor("v_").alias("v_"))
    return got.select(*by, "size", F.when(F.col("n_") == F.col("size"), _whole("v_", "size")).alias("crc32c"))


def matches(data: Column, crc: Column) -> Column:
    """Whether a frame's bytes have the CRC that came with it."""
    return crc32c(data) == crc.cast("long")
