"""Checksums that Spark lacks, over Arrow batches; SHA-256 is built in."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .crc import crc32c, crc32c_many  # noqa: F401


@F.pandas_udf(T.StringType())
def xxh3_64(data: pd.Series) -> pd.Series:
    return pd.Series([xxhash.xxh3_64_hexdigest(bytes(b)) for b in data])


@F.pandas_udf(T.LongType())
def weak_checksum(data: pd.Series) -> pd.Series:
    """Adler-like sum over signed bytes: (s1 mod 2**16) + (s2 << 16), mod 2**32."""

    def one(b):
        x = np.frombuffer(b, np.int8).astype(np.int64)
        return int(((x.sum() & 0xFFFF) + ((x * np.arange(len(x), 0, -1)).sum() << 16)) & 0xFFFFFFFF)

    return data.map(lambda b: one(bytes(b)))


@F.pandas_udf(T.DoubleType())
def entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes, in bits; 0 of none."""

    def one(b):
        n = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        p = n[n > 0] / max(1, len(b))
        return float(-(p * np.log2(p)).sum()) if len(b) else 0.0

    return data.map(lambda b: one(bytes(b)))


def sha(data: Column) -> Column:
    return F.sha2(data, 256)


def zero_digest(size: Column | int) -> Column:
    """The digest of so many zero bytes: a zero block is known by it, and needs no payload."""
    return sha(F.unhex(F.repeat(F.lit("00"), F.lit(size) if isinstance(size, int) else size)))


def stream_digest(rows, by: list[str], order: str = "seq"):
    """(by, digest, n_sent) of what is sent of each volume: SHA-256 over the digests of its blocks with a payload, in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, "digest")))
    return rows.where("kind = 'data'").groupBy(*by).agg(sha(F.concat_ws("", F.transform(parts, lambda p: p["digest"]))).alias("digest"), F.count("*").alias("n_sent"))


def sampled_digest(data: Column, size: int = 1 << 20) -> Column:
    """Of long volumes the first and last ``size`` bytes; of others the first ``size``."""
    n = F.octet_length(data)
    return F.when(n > 2 * size, sha(F.concat(F.substring(data, 1, size), F.substr(data, n - size + 1, F.lit(size))))).otherwise(sha(F.substring(data, 1, size)))
