"""A delta server's sessions: identity first, then signatures and deltas, at last the digest of the whole volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import sha

# Kinds of frames.
IDENTITY, SIGNATURES, DELTA, DIGEST = "I", "S", "D", "G"
#: Fields of an identity that must be the device's.
FIELDS = ("size_bytes", "kernel_uuid", "gpt_uuid", "mbr_signature", "fs_uuid", "major", "minor", "epoch")


def judged(frames: DataFrame, devices: DataFrame) -> DataFrame:
    """frames (volume_id, seq, kind, identity, offset, data, digest) with ``problem`` and ``live``.

    problem of a frame: kind (none of the four), device (its volume has none),
    identity (another than the device's; a null field is a value), missing (a
    delta before any identity), offset or bounds (a delta that is null or outside
    of the volume), digest (a last digest that isn't 64 hexadecimal characters).
    live: no frame of the session up to this one has a problem. devices:
    (volume_id, size, a struct ``device`` of FIELDS). Payloads take no part in the
    shuffle by session: it is of short rows that come back by seq.
    """
    size = F.octet_length("data")
    slim = frames.select("volume_id", "seq", "kind", "identity", "offset", size.alias("n_"), "digest").join(devices.select("volume_id", "size", "device"), "volume_id", "left")
    differ = F.lit(False)
    for f in FIELDS:
        differ = differ | ~F.col("identity")[f].eqNullSafe(F.col("device")[f])
    order = Window.partitionBy("volume_id").orderBy("seq")
    known = F.coalesce(F.max(F.col("kind") == IDENTITY).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    delta, last = F.col("kind") == DELTA, F.col("kind") == DIGEST
    outside = (F.col("offset") < 0) | (F.col("offset") > F.col("size") - F.col("n_"))
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(IDENTITY, SIGNATURES, DELTA, DIGEST), F.lit(False)), "kind").when(F.col("size").isNull(), "device").when((F.col("kind") == IDENTITY) & (F.col("identity").isNull() | differ), "identity")
        .when(delta & ~known, "missing").when(delta & (F.col("offset").isNull() | F.col("n_").isNull()), "offset").when(delta & outside, "bounds").when(last & ~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
    )
    bad = F.count_if(F.col("problem").isNotNull()).over(order)
    got = slim.withColumn("problem", problem).withColumn("live", bad == 0).select("volume_id", "seq", "problem", "live")
    return frames.join(got, ["volume_id", "seq"])


def written(blocks: DataFrame, judged: DataFrame, size: int) -> DataFrame:
    """blocks (volume_id, offset, data) of ``size`` bytes, the last shorter, after the live deltas, at any offsets: each is cut at block edges, and a block's pieces are laid over it in order, later ones over earlier ones."""
    d = judged.where(f"live and kind = '{DELTA}' and octet_length(data) > 0").select("volume_id", "seq", "offset", "data")
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.octet_length("data") - 1) / size)
    cut = d.select("volume_id", "seq", "offset", "data", F.explode(F.sequence(first, last)).alias("i_"))
    lo, hi = F.greatest(F.col("offset"), F.col("i_") * size), F.least(F.col("offset") + F.octet_length("data"), (F.col("i_") + 1) * size)
    piece = F.substr("data", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = cut.select("volume_id", (F.col("i_") * size).alias("offset"), "seq", (lo - F.col("i_") * size).cast("int").alias("at"), piece.alias("d"))
    over = pieces.groupBy("volume_id", "offset").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "d"))).alias("p_"))
    lay = lambda b, p: F.concat(F.substr(b, F.lit(1), p["at"]), p["d"], F.substr(b, p["at"] + F.octet_length(p["d"]) + 1))
    out = blocks.select("volume_id", "offset", "data").join(over, ["volume_id", "offset"], "left")
    return out.select("volume_id", "offset", F.when(F.col("p_").isNull(), F.col("data")).otherwise(F.aggregate("p_", F.col("data"), lay)).alias("data"))


def outcome(judged: DataFrame, after: DataFrame) -> DataFrame:
    """(volume_id, problem, n_deltas, digest): how each session ended: the problem of its first bad frame, else "final" where its last digest frame isn't the digest of the volume after it, else null. digest: SHA-256 over the SHA-256 digests of the blocks, in order, which such a frame holds."""
    parts = F.array_sort(F.collect_list(F.struct("offset", sha("data").alias("d"))))
    whole = after.groupBy("volume_id").agg(sha(F.concat_ws("", F.transform(parts, lambda p: p["d"]))).alias("digest"))
    live = F.col("live")
    ends = judged.groupBy("volume_id").agg(F.min_by(F.when(F.col("problem").isNotNull(), F.col("problem")), F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("bad"), F.count_if(live & (F.col("kind") == DELTA)).alias("n_deltas"), F.max_by("digest", F.when(live & (F.col("kind") == DIGEST), F.col("seq"))).alias("said"))
    got = ends.join(whole, "volume_id", "left")
    return got.select("volume_id", F.coalesce("bad", F.when(F.col("said") != F.col("digest"), "final")).alias("problem"), "n_deltas", "digest")
