"""Manifests: build, match, verify, collect and compact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha
from .chunking import blocks

KEY = ["volume_id", "offset", "length", "digest"]


def build(vol: DataFrame, size: int, *more: str) -> DataFrame:
    """(volume_id, more, seq, offset, length, digest): payloads are hashed in the scan and never shuffled."""
    return blocks(vol, size).select("volume_id", *more, "seq", "offset", "length", sha("data").alias("digest"))


def changed(new: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    return new.join(stored.select(*on), on, "left_anti")


def unchanged(new: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    return new.join(stored.select(*on), on, "left_semi")


def diff_status(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Each position's status: added, removed, same or changed."""
    o, n = old.select(*on, F.col("digest").alias("od")), new.select(*on, F.col("digest").alias("nd"))
    status = F.when(F.col("od").isNull(), "added").when(F.col("nd").isNull(), "removed").when(F.col("od") == F.col("nd"), "same").otherwise("changed")
    return o.join(n, on, "full").select(*on, status.alias("status"))


def verify(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """Stored entries of some length whose blocks are missing or have another digest."""
    a = actual.select("volume_id", "offset", F.col("digest").alias("actual"))
    return stored.where("length > 0").join(a, ["volume_id", "offset"], "left").where(F.col("actual").isNull() | (F.col("actual") != F.col("digest"))).select("volume_id", "offset", F.when(F.col("actual").isNull(), "missing").otherwise("mismatch").alias("problem"))


def mismatch_counts(found: DataFrame) -> DataFrame:
    """(problem, n): how many entries ``verify`` found of each problem."""
    return found.groupBy("problem").agg(F.count("*").alias("n"))


def collect_garbage(entries: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Drop empty entries; of equal keys the first in order stays. An aggregate, so that a key with very many entries, such as the zero block, is summed in the tasks first."""
    rest = [c for c in entries.columns if c not in (*by, *order)]
    best = entries.where("length > 0").groupBy(*by).agg(F.min(F.struct(*(c for c in order if c not in by), *rest)).alias("e"))
    return best.select(*by, "e.*").select(*entries.columns)


def upsert(entries: DataFrame, slot: list[str], version: str) -> DataFrame:
    """The last version of each slot; of rows of one version the largest."""
    rest = [c for c in entries.columns if c not in (*slot, version)]
    best = entries.groupBy(*slot).agg(F.max(F.struct(version, *rest)).alias("e"))
    return best.select(*slot, "e.*").select(*entries.columns)


def set_ops(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """The different keys in both tables (intersect), in the first alone (difference) or in either (union)."""
    x, y = a.select(*on), b.select(*on)
    return {"intersect": x.intersect, "difference": x.subtract, "union": lambda y: x.union(y).distinct()}[how](y)


#: Digests that are hashed together, as text of 64 characters each.
RUN = 4096


def digest_of_digests(entries: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over a volume's chunk digests in offset order. A group holds (offset, digest) of one volume, 100 bytes a chunk; for volumes of very many chunks see ``digest_tree``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "digest")))
    return entries.groupBy(*by).agg(sha(F.concat_ws("", F.transform(parts, lambda p: p["digest"]))).alias("root"), F.count("*").alias("n_chunks"))


def digest_tree(entries: DataFrame, by: list[str], run: int = RUN, levels: int = 3) -> DataFrame:
    """(by, root, n_chunks): SHA-256 in levels: of each run of ``run`` digests by seq, then of those, ``levels`` times, so that no group holds more than ``run`` of them while a volume has at most run ** levels chunks. Another value than ``digest_of_digests``, and as good to compare two volumes by."""
    out = entries.select(*by, F.col("seq").alias("seq_"), "digest", F.lit(1).cast("long").alias("n_"))
    for level in range(levels):
        top = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("seq_") / run)
        parts = F.array_sort(F.collect_list(F.struct("seq_", "digest")))
        out = out.groupBy(*by, top.alias("up_")).agg(sha(F.concat_ws("", F.transform(parts, lambda p: p["digest"]))).alias("digest"), F.sum("n_").alias("n_")).withColumnRenamed("up_", "seq_")
    return out.select(*by, F.col("digest").alias("root"), F.col("n_").alias("n_chunks"))


def alignment(entries: DataFrame, by: list[str], sector: int) -> DataFrame:
    """(by, fallback): whether an offset or length is off the grid of sectors, so that direct reads won't do."""
    return entries.groupBy(*by).agg(F.bool_or((F.col("offset") % sector != 0) | (F.col("length") % sector != 0)).alias("fallback"))


def state_changes(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Blocks (volume_id, offset, digest) that a stored state (volume_id, offset, digest) doesn't have so, with ``is_new`` where it has nothing at their offset."""
    old = state.select("volume_id", "offset", F.col("digest").alias("old"))
    return blocks.join(old, ["volume_id", "offset"], "left").where("old is null or old <> digest").withColumn("is_new", F.col("old").isNull()).drop("old")


def next_state(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """The state after the changes are sent: what blocks say where they say something, else what was stored."""
    new = blocks.select("volume_id", "offset", F.col("digest").alias("new"))
    return state.select("volume_id", "offset", "digest").join(new, ["volume_id", "offset"], "full").select("volume_id", "offset", F.coalesce("new", "digest").alias("digest"))


def lookup_stats(asked: DataFrame, known: DataFrame, on: str = "digest") -> DataFrame:
    """(n_lookups, n_hits, hit_rate) of asking an exact set; the rate is null of no lookups."""
    got = asked.join(known.select(on).distinct().withColumn("hit_", F.lit(True)), on, "left")
    return got.agg(F.count("*").alias("n_lookups"), F.count_if("hit_").alias("n_hits")).withColumn("hit_rate", F.try_divide("n_hits", "n_lookups"))


def stale_volumes(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """Volumes whose manifest must be rebuilt: an entry is gone, new or different."""
    return diff_status(stored, actual, ["volume_id", "offset"]).groupBy("volume_id").agg(F.bool_or(F.col("status") != "same").alias("stale"))


def structural_check(entries: DataFrame, size: int) -> DataFrame:
    """Entries that can't stand: off the grid, too long, negative or no digest."""
    return entries.where((F.col("offset") % size != 0) | (F.col("length") > size) | (F.col("length") < 0) | (F.length("digest") != 64))


def header_mac(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumn("mac", sha(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))))
