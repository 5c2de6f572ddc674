"""A dump from end to end: what each block becomes, the frames that are sent, the checks of the receiver, and the log of what it wrote.

blocks: (volume_id, seq, offset, length, data). Content that is left out is
always named by where else it stands, so that applying restores it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import crc32c, sha
from .chunking import holes, is_zero
from .ranges import coalesce_runs, contained
from .state import fifo_dedup

#: Kinds that send nothing, and kinds that send no payload.
SKIPPED, EMPTY = ("match", "state", "intra"), ("hole", "zero")
MOST = (1 << 63) - 1


def classify_dump(blocks: DataFrame, stored: DataFrame | None = None, state: DataFrame | None = None, extents: DataFrame | None = None, intra: int = 0, width: int = 1 << 20) -> DataFrame:
    """(volume_id, seq, offset, length, digest, kind, ref_seq): the kind of each block, tested in this order.

    hole: no extent of data (volume_id, start, end) reaches into it. match: the
    stored manifest (volume_id, offset, length, digest) has it. state: the
    stored state of the last run (volume_id, offset, digest) has it. intra: its
    content is among the last ``intra`` different ones of its volume; ref_seq is
    the block that has it. zero: all bytes are 0. data: the rest. A test whose
    table is missing finds nothing. Payloads are hashed in the scan and take
    part in no join.
    """
    slim = blocks.select("volume_id", "seq", "offset", "length", sha("data").alias("digest"), is_zero(F.col("data")).alias("zero"))
    slim = holes(slim, extents, width) if extents is not None else slim.withColumn("hole", F.lit(False))
    none = F.lit(None).cast("string")
    for name, table, keys in (("match", stored, ["volume_id", "offset", "length"]), ("state", state, ["volume_id", "offset"])):
        slim = slim.withColumn(name, none) if table is None else slim.join(table.select(*keys, F.col("digest").alias(name)), keys, "left")
    early = F.when(F.col("hole"), "hole").when(F.col("match") == F.col("digest"), "match").when(F.col("state") == F.col("digest"), "state")
    slim = slim.withColumn("kind", early)
    if intra:
        hits = fifo_dedup(slim.where("kind is null"), "volume_id", "seq", intra).where("hit").select("volume_id", "seq", F.col("at").alias("ref_seq"))
        slim = slim.join(hits, ["volume_id", "seq"], "left")
    else:
        slim = slim.withColumn("ref_seq", F.lit(None).cast("long"))
    late = F.when(F.col("ref_seq").isNotNull(), "intra").when(F.col("zero"), "zero").otherwise("data")
    return slim.select("volume_id", "seq", "offset", "length", "digest", F.coalesce("kind", late).alias("kind"), "ref_seq")


def counters(kinds: DataFrame, by: list[str], parallel: bool = False) -> DataFrame:
    """(by, sent_bytes, n_skipped, n_sent): bytes of what is sent, blocks without payload counted by what they stand for, but not if ``parallel``."""
    sent = F.when(F.col("kind") == "data", F.col("length")).when(F.col("kind").isin(*EMPTY), F.lit(0) if parallel else F.col("length")).otherwise(0)
    return kinds.groupBy(*by).agg(F.sum(sent).cast("long").alias("sent_bytes"), F.count_if(F.col("kind").isin(*SKIPPED)).alias("n_skipped"), F.count_if(~F.col("kind").isin(*SKIPPED)).alias("n_sent"))


def frames(blocks: DataFrame, kinds: DataFrame) -> DataFrame:
    """(volume_id, seq, offset, length, crc, digest, data, size) of what is sent: a hole or a zero block has length 0, crc 0 and no data; size is what the block has."""
    data = blocks.join(kinds.where("kind = 'data'").select("volume_id", "seq"), ["volume_id", "seq"], "left_semi").select("volume_id", "seq", "data")
    out = kinds.where(~F.col("kind").isin(*SKIPPED)).join(data, ["volume_id", "seq"], "left")
    full = F.col("data").isNotNull()
    return out.select("volume_id", "seq", "offset", F.when(full, F.col("length")).otherwise(0).alias("length"), F.when(full, crc32c(F.coalesce("data", F.lit(b"")))).otherwise(F.lit(0).cast("long")).alias("crc"), F.when(full, F.col("digest")).alias("digest"), "data", F.col("length").alias("size"))


def frame_problem() -> Column:
    """The first check that a frame fails: offset (below 0 or past 2**63 - 1), length (not that of its data), crc, digest (only where one was sent); null if none."""
    data = F.coalesce(F.col("data"), F.lit(b""))
    offset = (F.col("offset") < 0) | (F.col("offset") > MOST - F.col("length"))
    return F.when(offset, "offset").when(F.octet_length(data) != F.col("length"), "length").when(crc32c(data) != F.col("crc"), "crc").when(F.col("digest").isNotNull() & (F.col("length") > 0) & (sha(data) != F.col("digest")), "digest")


def in_bounds(deltas: DataFrame, sizes: DataFrame) -> DataFrame:
    """deltas (volume_id, offset, length) with problem "bounds" where they leave their volume (volume_id, size), "volume" where there is none."""
    out = deltas.join(sizes.select("volume_id", F.col("size").alias("size_")), "volume_id", "left")
    past = (F.col("offset") < 0) | (F.col("offset") + F.col("length") > F.col("size_"))
    return out.withColumn("problem", F.when(F.col("size_").isNull(), "volume").when(past, "bounds")).drop("size_")


def receive(sent: DataFrame, applied: DataFrame, state: DataFrame | None = None, width: int = 1 << 20) -> DataFrame:
    """sent frames with ``action``: skip (inside one applied range (volume_id, start, end)), then bad (with ``problem``), zero, same (the state already has it) or write."""
    rows = sent.withColumn("full_", F.when(F.col("length") > 0, F.col("length")).otherwise(F.col("size")))
    done = contained(rows.select("volume_id", "seq", "offset", F.col("full_").alias("length")), applied, ["volume_id"], width).select("volume_id", "seq", F.lit(True).alias("done_"))
    rows = rows.join(done, ["volume_id", "seq"], "left").withColumn("problem", F.when(F.col("done_").isNull(), frame_problem()))
    has = F.lit(None).cast("string")
    if state is not None:
        rows = rows.join(state.select("volume_id", "offset", F.col("digest").alias("has_")), ["volume_id", "offset"], "left")
        has = F.col("has_")
    zero = (F.col("length") == 0) | is_zero(F.coalesce("data", F.lit(b"")))
    action = F.when(F.col("done_"), "skip").when(F.col("problem").isNotNull(), "bad").when(zero, "zero").when(has == sha("data"), "same").otherwise("write")
    return rows.withColumn("action", action).select(*sent.columns, "action", "problem")


def written_ranges(received: DataFrame) -> DataFrame:
    """(volume_id, start, end, kind): what the log gets: each written frame, and runs of zero frames that follow each other in order and in place as one; a frame that is skipped in between doesn't end a run, any other does."""
    live = received.where("action in ('zero', 'write', 'same')").select("volume_id", "seq", "offset", F.when(F.col("length") > 0, F.col("length")).otherwise(F.col("size")).cast("long").alias("length"), "action")
    zero = coalesce_runs(live, ["volume_id"], "seq", keep=F.col("action") == "zero").select("volume_id", "start", (F.col("start") + F.col("length")).alias("end"), F.lit("zero").alias("kind"))
    data = live.where("action = 'write'").select("volume_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.lit("data").alias("kind"))
    return zero.union(data)


def after(base: DataFrame, received: DataFrame) -> DataFrame:
    """base (volume_id, offset, data) with the frames of ``receive`` in it; of frames for one offset the last counts, so doing it twice changes nothing."""
    body = F.when(F.col("action") == "zero", F.unhex(F.repeat(F.lit("00"), F.when(F.col("length") > 0, F.col("length")).otherwise(F.col("size")).cast("int")))).otherwise(F.col("data"))
    new = received.where("action in ('zero', 'write')").groupBy("volume_id", "offset").agg(F.max_by(body, "seq").alias("new"))
    return base.join(new, ["volume_id", "offset"], "full").select("volume_id", "offset", F.coalesce("new", "data").alias("data"))


def to_send(strategy: str, blocks: DataFrame, state: DataFrame, seed: int = 0) -> DataFrame:
    """blocks (volume_id, offset, data) that a strategy sends: none sends all; checksum and rolling_hash those whose digest, or seeded hash, isn't the state's at their offset; bloom those whose content the state has nowhere, by an exact set. Unknown names mean checksum. state: (volume_id, offset, digest, hash)."""
    if strategy == "none":
        return blocks
    if strategy == "bloom":
        return blocks.withColumn("digest", sha("data")).join(state.select("digest").distinct(), "digest", "left_anti").select(*blocks.columns)
    name, value = ("hash", seeded_hash(F.col("data"), seed)) if strategy == "rolling_hash" else ("digest", sha("data"))
    old = state.select("volume_id", "offset", F.col(name).alias("old_"))
    return blocks.withColumn("now_", value).join(old, ["volume_id", "offset"], "left").where("old_ is null or old_ <> now_").select(*blocks.columns)


def seeded_hash(data: Column, seed: int) -> Column:
    """64 bits of a hash of a whole block that a stored seed makes its own."""
    return F.xxhash64(F.lit(seed).cast("long"), data)


def state_of(blocks: DataFrame, seed: int = 0) -> DataFrame:
    """What a run stores for the next: (volume_id, offset, digest, hash)."""
    return blocks.select("volume_id", "offset", sha("data").alias("digest"), seeded_hash(F.col("data"), seed).alias("hash"))


def differs(a: Column, b: Column, fields: list[str]) -> Column:
    """The first field in which two structs differ, nulls alike; null if none."""
    return reduce(lambda out, f: out.when(~a[f].eqNullSafe(b[f]), f), fields[1:], F.when(~a[fields[0]].eqNullSafe(b[fields[0]]), fields[0]))
