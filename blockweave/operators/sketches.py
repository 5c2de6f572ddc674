"""Sketches of chunk sets, kept by volume: how much any volumes share, without their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch keeps 2**LG hashes: exact for sets up to that, beyond it estimates with a relative error of about 1 / sqrt(2**LG).
LG = 12


def build(entries: DataFrame, by: list[str], digest: str = "digest", lg: int = LG) -> DataFrame:
    """(by, sketch, n_chunks): a theta sketch of the different digests of each group, merged map-side; empty and null digests are none."""
    return entries.where(F.col(digest).isNotNull() & (F.col(digest) != "")).groupBy(*by).agg(F.theta_sketch_agg(digest, lg).alias("sketch"), F.count("*").alias("n_chunks"))


def parts_for(n_chunks: int, lg: int = LG) -> int:
    """How many parts keep the sketch of each exact, of a set of at most so many chunks: a part is half full, and differs from that by a percent or two."""
    return max(1, -(-n_chunks // 2 ** (lg - 1)))


def part_of(digest: Column, parts: int) -> Column:
    """The part of a chunk, by its digest: equal chunks are in one, so counts of parts add up to those of the set."""
    return F.pmod(F.xxhash64(digest), F.lit(parts))


def merged(sketches: DataFrame, by: list[str], lg: int = LG) -> DataFrame:
    """(by, sketch, n_chunks): the union of stored sketches by coarser groups."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", lg).alias("sketch"), F.sum("n_chunks").alias("n_chunks"))


def distinct(sketch: Column) -> Column:
    """How many different chunks, rounded."""
    return F.theta_sketch_estimate(sketch).cast("long")


def dedup_ratio(sketches: DataFrame) -> DataFrame:
    """sketches with n_distinct and ratio, the share of chunks that need no storing; null of none."""
    n = distinct(F.col("sketch"))
    return sketches.withColumn("n_distinct", n).withColumn("ratio", 1 - F.try_divide(F.col("n_distinct").cast("double"), F.col("n_chunks")))


def shared(a: Column, b: Column) -> Column:
    """How many different chunks two sets have in common."""
    return distinct(F.theta_intersection(a, b))


def added(new: Column, known: Column) -> Column:
    """How many different chunks of a set another lacks: what sending it would store."""
    return distinct(F.theta_difference(new, known))
