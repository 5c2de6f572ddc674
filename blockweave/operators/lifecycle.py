"""The life of a manifest: headers and entries as tables, from creation to compaction.

headers: one row for each volume, HEADER and its mac. entries: (volume_id, slot,
offset, length, flags, digest); a slot without a block has length 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha
from .manifest import diff_status

VERSION, OLD_VERSIONS = 2, (0, 1)
CDC = 1
# What a header's mac covers, in order.
HEADER = ("version", "block_size", "size_bytes", "chunk_count", "min_chunk", "avg_chunk", "max_chunk", "hybrid_size", "epoch", "major", "minor", "device_id", "kernel_uuid", "gpt_uuid", "mbr_signature", "partition_hash", "first_block_digest")
MAX_DEVICE_ID = 64


def mac() -> Column:
    return sha(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in HEADER)))


def sealed(headers: DataFrame) -> DataFrame:
    """headers with the mac of what they say now."""
    return headers.withColumn("mac", mac())


def create(volumes: DataFrame) -> DataFrame:
    """Headers of new manifests from (volume_id, block_size, size_bytes and any other fields of HEADER): the present version, as many slots as blocks begin. A block size of 0, or a device_id of over 64 bytes, has a problem and no slots."""
    have = set(volumes.columns)
    problem = F.when(F.coalesce(F.col("block_size"), F.lit(0)) <= 0, "block_size")
    if "device_id" in have:
        problem = problem.when(F.octet_length("device_id") > MAX_DEVICE_ID, "device_id")
    count = F.when(F.col("problem").isNull(), F.ceil(F.col("size_bytes") / F.col("block_size")))
    out = volumes.withColumns({f: F.lit(None).cast("string") for f in HEADER if f not in have})
    out = out.withColumn("problem", problem).withColumn("version", F.lit(VERSION)).withColumn("chunk_count", count)
    return sealed(out).select("volume_id", *HEADER, "mac", "problem")


def open_manifest(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """headers with the first problem that forbids their use: mac, version, size (not as many slots as the header says), or null."""
    n = entries.groupBy("volume_id").agg(F.count("*").alias("n_"))
    out = headers.drop("problem").join(n, "volume_id", "left")
    problem = F.when(~F.col("mac").eqNullSafe(mac()), "mac").when(F.col("version") != VERSION, "version").when(F.coalesce("n_", F.lit(0)) != F.coalesce("chunk_count", F.lit(0)), "size")
    return out.withColumn("problem", problem).drop("n_")


def upgrade(headers: DataFrame) -> DataFrame:
    """headers of old versions in the present one, sealed again; problem is mac for a broken header, version for one that is not known."""
    sound, old = F.col("mac").eqNullSafe(mac()), F.col("version").isin(*OLD_VERSIONS)
    problem = F.when(~sound, "mac").when(~old & (F.col("version") != VERSION), "version")
    out = headers.drop("problem").withColumn("problem", problem)
    out = out.withColumn("version", F.when(F.col("problem").isNull(), F.lit(VERSION)).otherwise(F.col("version")))
    return out.withColumn("mac", F.when(F.col("problem").isNull(), mac()).otherwise(F.col("mac")))


def entry(headers: DataFrame, entries: DataFrame, slots: DataFrame) -> DataFrame:
    """The entries of asked slots (volume_id, slot), with problem "range" for slots past the manifest's end."""
    got = slots.join(headers.select("volume_id", "chunk_count"), "volume_id", "left").join(entries, ["volume_id", "slot"], "left")
    return got.withColumn("problem", F.when((F.col("slot") < 0) | (F.col("slot") >= F.coalesce("chunk_count", F.lit(0))), "range")).drop("chunk_count")


def cdc_entries(entries: DataFrame) -> DataFrame:
    """(volume_id, offset, length, digest) of the content-defined chunks that a manifest holds."""
    return entries.where((F.col("flags").bitwiseAND(CDC) != 0) & (F.col("length") > 0)).select("volume_id", "offset", "length", "digest")


def compact(headers: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest written anew with nothing dropped: all slots, empty ones too, each once under its number; headers keep every field and are sealed again."""
    return sealed(headers.drop("mac", "problem")), entries.dropDuplicates(["volume_id", "slot"])


def collect(headers: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest without empty slots, and of entries for one offset only that of the lowest slot; headers keep every field and are sealed again. One aggregate by offset, whatever its entries."""
    rest = [c for c in entries.columns if c not in ("volume_id", "offset", "slot")]
    best = entries.where("length > 0").groupBy("volume_id", "offset").agg(F.min(F.struct("slot", *rest)).alias("e"))
    return sealed(headers.drop("mac", "problem")), best.select("volume_id", "offset", "e.*").select(*entries.columns)


def regenerate(headers: DataFrame, entries: DataFrame, actual: DataFrame, sizes: DataFrame) -> DataFrame:
    """(volume_id, why): volumes whose manifest must be rebuilt, by the first reason: missing (no header), mac, version, size (of the volume or of the slots), stale (an entry is gone, new or different).

    actual: (volume_id, offset, digest) of the blocks as they are; sizes:
    (volume_id, size). Only these volumes need their blocks written again.
    """
    opened = open_manifest(headers, entries).select("volume_id", "problem", "size_bytes", F.lit(True).alias("has"))
    live = entries.where("length > 0").select("volume_id", "offset", "digest")
    stale = diff_status(live, actual.select("volume_id", "offset", "digest"), ["volume_id", "offset"]).where("status <> 'same'").select("volume_id").distinct().withColumn("stale", F.lit(True))
    got = sizes.join(opened, "volume_id", "left").join(stale, "volume_id", "left")
    why = F.when(F.col("has").isNull(), "missing").when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("size_bytes") != F.col("size"), "size").when(F.col("stale"), "stale")
    return got.withColumn("why", why).where("why is not null").select("volume_id", "why")


def rebuilt(entries: DataFrame, actual: DataFrame, why: DataFrame) -> DataFrame:
    """entries with those of the volumes to be rebuilt replaced by the actual ones (volume_id, slot, offset, length, digest)."""
    fresh = actual.join(why.select("volume_id"), "volume_id", "left_semi").withColumn("flags", F.lit(0))
    return entries.join(why.select("volume_id"), "volume_id", "left_anti").unionByName(fresh.select(*entries.columns))


def range_words(entries: DataFrame, width: int) -> DataFrame:
    """(volume_id, range, word): for each range of so many bytes a word of 64 bits in which each entry sets two, by its digest's first bytes."""
    bit = lambda at: F.expr(f"shiftleft(1L, cast(conv(substr(digest, {at}, 2), 16, 10) as int) % 64)")
    return entries.groupBy("volume_id", F.floor(F.col("offset") / width).alias("range")).agg(F.bit_or(bit(1).bitwiseOR(bit(3))).alias("word"))


def may_hold(asked: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """asked (volume_id, offset, digest) with ``maybe``: false where the range's word shows that no entry has this digest; true is no promise."""
    bit = lambda at: F.expr(f"shiftleft(1L, cast(conv(substr(digest, {at}, 2), 16, 10) as int) % 64)")
    want = bit(1).bitwiseOR(bit(3))
    got = asked.withColumn("range", F.floor(F.col("offset") / width)).join(words, ["volume_id", "range"], "left")
    return got.withColumn("maybe", F.coalesce(F.col("word").bitwiseAND(want) == want, F.lit(False))).drop("range", "word")
