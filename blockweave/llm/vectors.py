"""Exact integer vectors: which rows take part, their entries as integers, and products of integer matrices by BLAS."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers below this are exact as float64.
EXACT = 1 << 53


def usable(column: str) -> Column:
    """The vector is there, and all its entries are there and finite."""
    v = F.col(f"`{column}`")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def common_length(df: DataFrame, column: str) -> int | None:
    """How many entries most vectors have; of equally common lengths the greatest. None of no rows."""
    got = df.groupBy(F.size(f"`{column}`").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return None if got is None else int(got["d"])


def entries(column: pa.Array, d: int, scale: int, shift: int, most: int) -> np.ndarray:
    """floor(scale * c) + shift of each entry as double, one row for each list of d entries; floor(scale * c) beyond ``most`` stops there."""
    flat = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(scale * flat), -most, most).astype(np.int64).reshape(len(column), d) + shift


def bits(a: np.ndarray) -> int:
    """Bits of the largest magnitude."""
    return max((abs(int(a.min())), abs(int(a.max())))).bit_length() if a.size else 0


def limbs(a: np.ndarray, width: int) -> list[np.ndarray]:
    """Digits of ``width`` bits as float64, the least first; the last carries the sign."""
    n = max(1, -(-(bits(a) + 1) // width))
    mask = (1 << width) - 1
    out = [((a >> (width * k)) & mask).astype(np.float64) for k in range(n - 1)]
    return [*out, (a >> (width * (n - 1))).astype(np.float64)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers (int64, or Python's in object arrays), exactly: int64 where that must suffice, else Python's integers.

    Each is split into digits so small that the float64 products of two digit
    matrices have no rounding at all; the products are added up at their powers
    as big integers.
    """
    inner = a.shape[1]
    most = bits(a) + bits(b) + inner.bit_length()
    if most < 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    width = (52 - inner.bit_length()) // 2
    left, right = limbs(a, width), limbs(b, width)
    out: np.ndarray | int = 0
    for power in range(len(left) + len(right) - 1):
        for i in range(max(0, power - len(right) + 1), min(power + 1, len(left))):
            part = (left[i] @ right[power - i]).astype(np.int64)
            out = out + ((part if most < 62 else part.astype(object)) << (width * power))
    return out
