"""Deltas: classify blocks, make what must be sent, apply it again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha
from ..sources.volumes import settled
from .chunking import blocks, is_zero


def classify(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new blocks (volume_id, offset, length, data) with a kind, tested in this order: match (the stored block is the same), zero, ref (the content stands at an earlier place: ref_volume, ref_offset), data.

    Content that is left out is always named by a ref row, so that apply can
    restore it. Payloads take no part in the joins: they are hashed first and
    come back by position for data rows alone.
    """
    slim = new.select("volume_id", "offset", "length", sha("data").alias("digest"), is_zero(F.col("data")).alias("zero"))
    old = stored.select("volume_id", "offset", F.col("digest").alias("old"))
    # Hashed once: first places and kinds are both made from these short rows.
    got = settled(slim.join(old, ["volume_id", "offset"], "left").withColumn("match", F.coalesce(F.col("old") == F.col("digest"), F.lit(False))).drop("old"))
    sent = got.where("not match and not zero").groupBy("digest", "length").agg(F.min(F.struct("volume_id", "offset")).alias("first"))
    got = got.join(sent, ["digest", "length"], "left")
    here = F.struct("volume_id", "offset")
    kind = F.when(F.col("match"), "match").when(F.col("zero"), "zero").when(F.col("first") < here, "ref").otherwise("data")
    got = got.withColumn("kind", kind)
    ref = F.col("kind") == "ref"
    return got.select("volume_id", "offset", "length", "digest", "kind", F.when(ref, F.col("first.volume_id")).alias("ref_volume"), F.when(ref, F.col("first.offset")).alias("ref_offset"))


def deltas(new: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows to send: payloads of data rows only."""
    data = new.join(kinds.where("kind = 'data'").select("volume_id", "offset"), ["volume_id", "offset"], "left_semi").select("volume_id", "offset", "data")
    return kinds.where("kind <> 'match'").join(data, ["volume_id", "offset"], "left")


def apply(base: DataFrame, sent: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks after the deltas: refs are resolved, zeros made, what wasn't sent stays, what is past a volume's new size (volume_id, n_blocks in bytes as size) goes."""
    data = sent.where("kind = 'data'").select(F.col("volume_id").alias("ref_volume"), F.col("offset").alias("ref_offset"), F.col("data").alias("other"))
    full = sent.join(data, ["ref_volume", "ref_offset"], "left")
    body = F.when(F.col("kind") == "zero", F.unhex(F.repeat(F.lit("00"), F.col("length")))).when(F.col("kind") == "ref", F.col("other")).otherwise(F.col("data"))
    new = full.select("volume_id", "offset", body.alias("new"))
    out = base.select("volume_id", "offset", F.col("data").alias("old")).join(new, ["volume_id", "offset"], "full")
    return out.join(sizes, "volume_id").where(F.col("offset") < F.col("size")).select("volume_id", "offset", F.coalesce("new", "old").alias("data"))


def overlay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base with the last version of each changed offset; idempotent. An aggregate, so that an offset written very often is summed in the tasks first."""
    last = changes.groupBy("volume_id", "offset").agg(F.max_by("digest", "version").alias("new"))
    return base.join(last, ["volume_id", "offset"], "full").select("volume_id", "offset", F.coalesce("new", "digest").alias("digest"))


#: Bytes that are compared at once; a run of differing bytes ends where they do.
COMPARE = 32 * 1024


def byte_runs(pairs: DataFrame, buffer: int = COMPARE) -> DataFrame:
    """(volume_id, start, length): runs of differing bytes of the common length of columns a and b, cut at multiples of ``buffer``. A null has no bytes."""

    def run(batches):
        for t in batches:
            rows = []
            for i in range(t.num_rows):
                a, b = (np.frombuffer(t.column(j)[i].as_buffer() or b"", np.uint8) for j in (1, 2))
                n = min(len(a), len(b))
                at = np.flatnonzero(a[:n] != b[:n])
                first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (at % buffer == 0))
                rows += [(t.column(0)[i].as_py(), int(s), int(k)) for s, k in zip(at[first], np.diff(np.append(first, len(at))), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["volume_id", "start", "length"])

    return pairs.select("volume_id", "a", "b").mapInArrow(run, "volume_id long, start long, length long")


def signatures(vol: DataFrame, least: int = 700, strong: str = "md5") -> DataFrame:
    """Weak and strong hashes of blocks of about the square root of the size. strong: md5, md4 or sha256."""
    from ..functions.hashing import sha, weak_checksum
    from ..functions.trees import md4

    hashes = {"md5": F.md5, "md4": md4, "sha256": sha}

    n = F.octet_length("data")
    size = F.greatest(F.lit(least), F.floor(F.sqrt(n))).cast("int")
    out = vol.withColumn("size", size).withColumn("seq", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.ceil(n / size)), lambda x: x < F.ceil(n / size))))
    out = out.withColumn("piece", F.substr("data", (F.col("seq") * F.col("size") + 1).cast("int"), F.col("size")))
    return out.select("volume_id", "size", "seq", weak_checksum("piece").alias("weak"), hashes[strong]("piece").alias("strong"))


__all__ = ["apply", "blocks", "byte_runs", "classify", "deltas", "overlay", "signatures"]
