"""Checkpoints: which are written, whether one fits, where a run goes on, and what must hold of its destination."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tolerant_equal
from .identity import NUMBERED, STABLE
from .ranges import sync_groups

# Settings that a checkpoint must share with the run, in the order in which they are compared; then its slots.
SETTINGS = ("transport", "compress", "checksum_algorithm", "dedup_mode")
SLOTS = ("fixed", "cdc", "hybrid")


def checkpoints(frames: DataFrame, by: list[str], order: str, every: int, at: str | None = None, after: float | None = None) -> DataFrame:
    """frames (by, order, length, ...) at which a checkpoint is written: those with which ``every`` bytes are sent since the last one, or that come ``after`` seconds or more past it; 0 bytes, or no time, is no reason. ``at`` has the seconds; time runs from a volume's first frame. A fold in order over slim frames, in one task for each volume; of a stream see ``streaming.stateful.syncs``."""
    if at is None or after is None:
        got = sync_groups(frames, by, order, every)
        full = got.groupBy(*by, "sync").agg(F.max(order).alias(order), F.sum("length").alias("n_")).where(F.col("n_") >= every)
        return frames.join(full.select(*by, order), [*by, order], "left_semi")
    slim = frames.select(*by, order, F.col("length").cast("long").alias("length"), F.col(at).cast("double").alias("at_"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, last, due = pdf.sort_values(order), 0, None, []
        for n, now in zip(pdf["length"].tolist(), pdf["at_"].tolist(), strict=True):
            last, held = (now if last is None else last), held + n
            due.append((every > 0 and held >= every) or now - last >= after)
            if due[-1]:
                held, last = 0, now
        return pdf[due][[*by, order]]

    return frames.join(slim.groupBy(*by).applyInPandas(walk, slim.select(*by, order).schema), [*by, order], "left_semi")


def checkpoint_problem(saved: Column, run: Column, device: Column, digest: Column) -> Column:
    """The first thing that keeps a saved checkpoint from a run: one of SETTINGS, resume_token (both set and different), a field of the device (known on both sides and different), or first_block_digest; null if it fits, "missing" if there is none."""
    out = F.when(saved.isNull(), "missing")
    for f in SETTINGS:
        out = out.when(~saved[f].eqNullSafe(run[f]), F.lit(f))
    out = out.when(~tolerant_equal(saved["resume_token"], run["resume_token"]), F.lit("resume_token"))
    for f in STABLE + NUMBERED:
        out = out.when(~tolerant_equal(saved["device"][f], device[f]), F.lit(f))
    return out.when(~tolerant_equal(saved["first_block_digest"], digest), F.lit("first_block_digest"))


def slot(saved: Column) -> Column:
    """The slot (offset, length, chunk) of a checkpoint for its own dedup_mode, the fixed one for other modes; null if its chunk is no digest."""
    mode = F.lower(F.coalesce(saved["dedup_mode"], F.lit("")))
    got = F.when(mode == "cdc", saved["cdc"]).when(mode == "hybrid", saved["hybrid"]).otherwise(saved["fixed"])
    return F.when(got["chunk"].rlike("^[0-9a-fA-F]{64}$"), got)


def load_checkpoint(runs: DataFrame) -> DataFrame:
    """(key, source, problem, resume): the checkpoint that each run goes on from.

    runs: (key, log, state, run, device, digest): a checkpoint in a log not yet
    renamed is tried first, then the state. source: log, state or null; problem
    is the state's where neither fits; resume: the slot.
    """
    args = (F.col("run"), F.col("device"), F.col("digest"))
    a, b = (checkpoint_problem(F.col(c), *args) for c in ("log", "state"))
    out = runs.select("key", "log", "state", a.alias("a"), b.alias("b"))
    source = F.when(F.col("a").isNull(), "log").when(F.col("b").isNull(), "state")
    return out.select("key", source.alias("source"), F.when(F.col("a").isNotNull(), F.col("b")).alias("problem"), F.when(F.col("a").isNull(), slot(F.col("log"))).when(F.col("b").isNull(), slot(F.col("state"))).alias("resume"))


def destination_failure(d: Column, m: Column, c: Column) -> Column:
    """The first check that a destination fails; null if it may be written.

    d: struct(device_id, STABLE and NUMBERED fields, first_block_digest,
    mounted_rw). m: the manifest's header with the same fields, or null. c:
    struct(resume_state: whether one is given, resume_fits, device_uuid,
    first_block_digest, force). With a manifest: id, size, identity, digest,
    resume, mounted; without: resume, uuid, digest, mounted.
    """
    same = reduce(and_, (d[f].eqNullSafe(m[f]) for f in STABLE + NUMBERED))
    mounted = d["mounted_rw"] & ~c["force"]
    known = F.when(~d["device_id"].eqNullSafe(m["device_id"]), "id").when(~d["size_bytes"].eqNullSafe(m["size_bytes"]), "size").when(~same, "identity")
    known = known.when(~d["first_block_digest"].eqNullSafe(m["first_block_digest"]), "digest").when(c["resume_state"] & ~c["resume_fits"], "resume").when(mounted, "mounted")
    set_ = lambda f: F.coalesce(c[f], F.lit("")) != ""
    free = F.when(c["resume_state"] & ~c["resume_fits"], "resume").when(set_("device_uuid") & ~d["device_id"].eqNullSafe(c["device_uuid"]), "uuid")
    free = free.when(set_("first_block_digest") & ~d["first_block_digest"].eqNullSafe(c["first_block_digest"]), "digest").when(mounted, "mounted")
    return F.when(m.isNotNull(), known).otherwise(free)


def probe(devices: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each device (key, d: a struct as for destination_failure, force) with its identity, the manifest's epoch where there is one (headers: key, m), and the first problem: id, size, numbers, digest, mounted."""
    got = devices.join(headers, "key", "left")
    d, m = F.col("d"), F.col("m")
    has = m.isNotNull()
    problem = F.when(has & ~d["device_id"].eqNullSafe(m["device_id"]), "id").when(has & ~d["size_bytes"].eqNullSafe(m["size_bytes"]), "size")
    problem = problem.when(has & ~(d["major"].eqNullSafe(m["major"]) & d["minor"].eqNullSafe(m["minor"])), "numbers")
    problem = problem.when(has & ~d["first_block_digest"].eqNullSafe(m["first_block_digest"]), "digest").when(d["mounted_rw"] & ~F.col("force"), "mounted")
    return got.select("key", *(d[f].alias(f) for f in (*STABLE[:-1], *NUMBERED)), F.when(has, m["manifest_epoch"]).otherwise(d["manifest_epoch"]).alias("manifest_epoch"), problem.alias("problem"))


def log_mismatch(applied: DataFrame, entries: DataFrame) -> DataFrame:
    """Applied ranges (volume_id, start, end, digest of what is there now) that the manifest's entries (volume_id, offset, length, flags, digest) don't confirm: the first such range forbids going on."""
    a = applied.withColumn("length", F.col("end") - F.col("start")).withColumn("offset", F.col("start"))
    e = entries.where("flags = 0").select("volume_id", "offset", F.col("length").cast("long").alias("length"), "digest")
    return a.join(e, ["volume_id", "offset", "length", "digest"], "left_anti").select(*applied.columns)
