"""Byte ranges, half-open throughout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def change_ranges(log: DataFrame, chunk: int) -> DataFrame:
    """Ranges (pos, start, end) of a change log (log_id, pos, origin_chunk, snap_chunk): entries before the first with snap_chunk 0, in log order, not merged."""
    stop = log.where("snap_chunk = 0").groupBy("log_id").agg(F.min("pos").alias("stop"))
    live = log.join(stop, "log_id", "left").where(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    return live.select("log_id", "pos", (F.col("origin_chunk") * chunk).alias("start"), ((F.col("origin_chunk") + 1) * chunk).alias("end"))


def total_bytes(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of all ranges that aren't inverted, held at 2**63 - 1."""
    size = (F.col("end").cast("decimal(20,0)") - F.col("start").cast("decimal(20,0)")).cast("decimal(21,0)")
    total = F.least(F.sum(size), F.lit(2**63 - 1).cast("decimal(31,0)"))
    return ranges.where(F.col("end") > F.col("start")).groupBy(*by).agg(total.cast("long").alias("total"))


def coalesce_runs(frames: DataFrame, by: list[str], order: str, start: str = "offset", length: str = "length", keep: Column | None = None) -> DataFrame:
    """Join frames that follow each other in order and in place; frames that ``keep`` refuses end a run and are left out."""
    w = Window.partitionBy(*by).orderBy(order)
    ok = keep if keep is not None else F.lit(True)
    before = F.lag(F.col(start) + F.col(length)).over(w)
    new = ~F.coalesce((before == F.col(start)) & F.lag(ok).over(w), F.lit(False)) | ~ok
    run = F.sum(F.when(new, 1).otherwise(0)).over(w)
    return frames.withColumn("run_", run).where(ok).groupBy(*by, "run_").agg(F.min(start).alias("start"), F.sum(length).cast("long").alias("length"), F.count("*").alias("n_frames")).drop("run_")


#: Intervals are of 4**level units, level up to this.
LEVELS = 31


def dyadic(start: Column, end: Column) -> Column:
    """The fewest aligned intervals of powers of four that make up [start, end) of units, as array<struct(level, at)>: six for each two bits of its length at most; none of an empty range."""
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def at(level):
        bits = level * 2
        up = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        a, b = F.call_function("shiftright", start + F.least(up, F.lit(2**63 - 1) - start), bits), F.call_function("shiftright", end, bits)
        inner_a, inner_b = F.call_function("shiftright", a + 3, F.lit(2)) * 4, F.call_function("shiftright", b, F.lit(2)) * 4
        here = F.when(a >= b, none).when(inner_a <= inner_b, F.concat(run(a, inner_a), run(inner_b, b))).otherwise(run(a, b))
        return F.transform(here, lambda x: F.struct(level.cast("int").alias("level"), x.alias("at")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def covers(ranges: DataFrame, by: list[str], unit: int) -> DataFrame:
    """(by, start_, end_, level_, at_): each range that isn't empty as aligned intervals, cut outward to whole units."""
    a, b = F.floor(F.col("start") / unit).cast("long"), F.floor((F.col("end") - 1) / unit).cast("long") + 1
    return ranges.where(F.col("end") > F.col("start")).where("start >= 0").select(*by, F.col("start").alias("start_"), F.col("end").alias("end_"), F.inline(dyadic(a, b)).alias("level_", "at_"))


def _asking(points: DataFrame, at: str, pieces: DataFrame, unit: int) -> DataFrame:
    """points with (level_, at_): on each level that the pieces have, the interval that holds the point."""
    levels = pieces.agg(F.collect_set("level_").alias("levels_")).scalar()
    asked = points.withColumn("levels_", levels)
    number = F.floor(F.col(at) / unit).cast("long")
    asked = asked.withColumn("levels_", F.transform("levels_", lambda v: F.struct(v.alias("level_"), F.call_function("shiftright", number, v * 2).alias("at_"))))
    return asked.select(*points.columns, F.inline("levels_"))


def contained(blocks: DataFrame, ranges: DataFrame, by: list[str], width: int) -> DataFrame:
    """Blocks (offset, length) inside one range (start, end); adjacent ranges don't count as one. Offsets from 0.

    An equi-join on aligned intervals instead of a nested loop: a range is six
    rows at most for each two bits of its length in units of ``width``, however
    long it is, and a block asks for those that hold its first byte, on the levels
    that there are. What is found is compared exactly, so width matters for speed
    alone; choose it near the blocks' size.
    """
    pieces = covers(ranges, by, width)
    b = _asking(blocks.withColumn("id_", F.monotonically_increasing_id()), "offset", pieces, width)
    on = [b[c] == pieces[c] for c in by] + [b["level_"] == pieces["level_"], b["at_"] == pieces["at_"], b["offset"] >= pieces["start_"], b["offset"] + b["length"] <= pieces["end_"]]
    return b.join(pieces, on, "left_semi").dropDuplicates(["id_"]).select(*blocks.columns)


def holding(points: DataFrame, at: str, ranges: DataFrame, by: list[str], width: int) -> DataFrame:
    """(points' columns, start_, end_): each point with each range (by, start, end) that holds it, by aligned intervals as ``contained``."""
    pieces = covers(ranges, by, width)
    got = _asking(points, at, pieces, width).join(pieces, [*by, "level_", "at_"])
    return got.where((F.col(at) >= F.col("start_")) & (F.col(at) < F.col("end_"))).select(*points.columns, "start_", "end_")


def resume_after(ranges: DataFrame, by: list[str], digest: str) -> DataFrame:
    """Ranges after the first with this digest; all if none has it."""
    at = ranges.where(F.col("digest") == digest).groupBy(*by).agg(F.min("seq").alias("at_"))
    return ranges.join(at, by, "left").where(F.col("at_").isNull() | (F.col("seq") > F.col("at_"))).drop("at_")


def resume_from(ranges: DataFrame, offset: int) -> DataFrame:
    """Ranges past an offset, the one it falls in cut there."""
    return ranges.where(F.col("end") > offset).withColumn("start", F.greatest(F.col("start"), F.lit(offset)))


def sync_groups(frames: DataFrame, by: list[str], order: str, every: int) -> DataFrame:
    """(by, order, length, sync): the number of the sync that covers each frame. A sync comes after the frame with which so many bytes are written since the last one, and counting starts anew: a fold in order, in one task for each volume, over its slim frames alone."""
    slim = frames.select(*by, order, F.col("length").cast("long").alias("length"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, number, out = pdf.sort_values(order), 0, 0, []
        for n in pdf["length"].tolist():
            held += n
            out.append(number)
            if held >= every:
                held, number = 0, number + 1
        return pdf.assign(sync=out)

    return slim.groupBy(*by).applyInPandas(walk, T.StructType([*slim.schema.fields, T.StructField("sync", T.LongType())]))


def resolve(volumes: DataFrame, logged: DataFrame, size: int) -> DataFrame:
    """(volume_id, seq, start, end): the blocks to look at: those of a volume's change log (volume_id, start, end) where it has one, else all of it (volume_id, size), cut at ``size``."""
    whole = volumes.join(logged.select("volume_id").distinct(), "volume_id", "left_anti").select("volume_id", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    got = logged.select("volume_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).union(whole).where(F.col("end") > F.col("start"))
    n = F.ceil((F.col("end") - F.col("start")) / size)
    cut = got.select("volume_id", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda x: x < n)).alias("i"))
    at = F.col("s") + F.col("i") * size
    return cut.select("volume_id", F.col("i").alias("seq"), at.alias("start"), F.least(F.col("e"), at + size).alias("end"))
