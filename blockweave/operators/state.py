"""Estimates, caches and limits that walk rows in order."""

from __future__ import annotations

import heapq
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..sources.volumes import bound_batches, settled
from .chunking import spread

#: Bytes that a chunk's ratio is estimated from.
SAMPLE = 8192


def systematic_estimate(blocks: DataFrame, stored: DataFrame, by: list[str], samples: int = 100) -> DataFrame:
    """Estimated changed bytes by volume: of every (chunks div samples)-th block, at most ``samples``, the share that differs from the stored one."""
    n = blocks.groupBy(*by).agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("size"))
    b = blocks.join(n, by)
    take = F.least(F.lit(samples), F.col("n"))
    step = F.floor(F.col("n") / take)
    b = b.where((F.col("seq") % step == 0) & (F.col("seq") < take * step))
    old = stored.select(*by, "seq", F.col("digest").alias("old"))
    hit = b.join(old, [*by, "seq"], "left").groupBy(*by, "size").agg(F.avg(F.when(F.col("old") == F.col("digest"), 0.0).otherwise(1.0)).alias("ratio"))
    return hit.withColumn("estimate", F.floor(F.round(F.col("ratio") * F.col("size"), 6)).cast("long"))


def argmax_fit(df: DataFrame, by: list[str], key: str, free: str, need: float) -> DataFrame:
    """By group the row with the most free space that fits; of ties the first key."""
    w = Window.partitionBy(*by).orderBy(F.desc(free), key)
    return df.where(F.col(free) >= need).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def lru_ttl(access: DataFrame, key: str, at: str, now, ttl: str, keep: int) -> DataFrame:
    """What a cache holds at a time: keys used within ttl, the last ``keep`` of them."""
    last = access.groupBy(key).agg(F.max(at).alias("last_used"), F.count("*").alias("n_uses"))
    return last.where(F.col("last_used") >= now - F.expr(f"INTERVAL {ttl}")).orderBy(F.desc("last_used"), key).limit(keep)


def fifo_dedup(blocks: DataFrame, group: str, order: str, capacity: int = 4096) -> DataFrame:
    """(group, order, hit, at): which blocks repeat one of the last ``capacity`` distinct digests of their group, and the one that put it there; a hit doesn't refresh."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seen, at = pdf.sort_values(order), OrderedDict(), []
        for d, o in zip(pdf["digest"], pdf[order], strict=True):
            at.append(seen.get(d))
            if d not in seen:
                seen[d] = o
                if len(seen) > capacity:
                    seen.popitem(last=False)
        return pd.DataFrame({group: pdf[group].to_numpy(), order: pdf[order].to_numpy(), "hit": [x is not None for x in at], "at": pd.array(at, "Int64")})

    return blocks.select(group, order, "digest").groupBy(group).applyInPandas(walk, f"{group} long, {order} long, hit boolean, at long")


def token_bucket(requests: DataFrame, group: str, at: str, amount: str, rate: float, burst: float) -> DataFrame:
    """Seconds each request waits; one above the burst is split and pays as it refills."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, level, clock, waits = pdf.sort_values([at, amount]), burst, None, []
        for t, a in zip(pdf[at], pdf[amount], strict=True):
            start = t if clock is None else max(t, clock)
            if clock is not None:
                level = min(burst, level + (start - clock) * rate)
            done = start + max(0.0, a - level) / rate
            level = max(0.0, level - a)
            clock = done
            waits.append(done - t)
        return pdf.assign(wait=waits)[[group, at, amount, "wait"]]

    return requests.select(group, at, amount).groupBy(group).applyInPandas(walk, f"{group} long, {at} double, {amount} double, wait double")


@F.pandas_udf(DoubleType())
def compress_ratio(data: pd.Series) -> pd.Series:
    """Compressed size over size of the first 8 KiB; 1 of nothing."""
    z = zstandard.ZstdCompressor(level=1)
    return data.map(lambda b: len(z.compress(bytes(b)[:SAMPLE])) / len(bytes(b)[:SAMPLE]) if len(b) else 1.0)


def progress(frames: DataFrame, by: list[str], order: str, every: int = 100) -> DataFrame:
    """Percent done at every so many frames; null where nothing is to be done."""
    w, all_ = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    done = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = frames.withColumns({"n_": F.row_number().over(w), "done_bytes": done, "percent": F.try_divide(100 * done, F.sum("length").over(all_))})
    return out.where(F.col("n_") % every == 0).select(*by, order, "done_bytes", "percent")


def throughput(done_bytes, seconds):
    """MiB a second; null of no time."""
    return F.try_divide(done_bytes / 1048576.0, seconds)


def window_entropy(vol: DataFrame, size: int = 64) -> DataFrame:
    """(volume_id, at, entropy): bits of entropy of each block of ``size`` bytes of a volume, from counts of byte values; a short tail counts as it is."""

    def run(batches):
        for b in batches:
            out, held = [], 0
            for key, data in zip(b.column(0), b.column(1), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8) if data.is_valid else np.zeros(0, np.uint8)
                for at in range(0, len(raw), size * WINDOWS):
                    bits = entropies(raw[at : at + size * WINDOWS], size)
                    out.append(pa.record_batch([pa.repeat(key, len(bits)), pa.array(at + size * np.arange(len(bits))), pa.array(bits)], ["volume_id", "at", "entropy"]))
                    held += len(bits)
                    if held >= 16 * WINDOWS:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out, held = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    bound_batches(vol.sparkSession)
    return spread(vol.select(F.col("volume_id").cast("long"), "data")).mapInArrow(run, "volume_id long, at long, entropy double")


#: Windows whose bytes are counted at once.
WINDOWS = 1 << 12


def entropies(raw: np.ndarray, size: int) -> np.ndarray:
    """Bits of entropy of each ``size`` bytes of raw; the last may be shorter."""
    window = np.arange(len(raw)) // size
    counts = np.bincount(window * 256 + raw, minlength=-(-len(raw) // size) * 256)
    at = np.flatnonzero(counts)
    n = np.bincount(window)
    p = counts[at] / n[at >> 8]
    return np.bincount(at >> 8, -p * np.log2(p))


def work_waves(tasks: DataFrame, by: list[str], order: str, bdp: int, chunk: int) -> DataFrame:
    """tasks with the wave in which a window of max(1, ceil(bdp / chunk)) of them, in order, sends them when none fails."""
    w = Window.partitionBy(*by).orderBy(order)
    return tasks.withColumn("wave", F.floor((F.row_number().over(w) - 1) / window_size(bdp, chunk)).cast("long"))


def window_size(bdp: int, chunk: int) -> int:
    """Chunks in flight at once."""
    return max(1, -(-bdp // max(1, chunk)))


#: Milliseconds before a task that failed once is tried again; each further failure doubles them.
BACKOFF = 10


def work_queue(tasks: DataFrame, group: str, bdp: int, chunk: int, step: int = 1) -> DataFrame:
    """(group, seq, task, attempt, at, done): the sends of a queue, in order.

    tasks (group, task, failures): each fails so often before it is done. Time
    goes in steps of ``step`` milliseconds. At each, all that is in flight ends,
    done or failed, then the window is filled: with failed tasks whose wait is
    over, least number first, else with the next new one. The k-th failure of a
    task makes it wait BACKOFF * 2 ** (k - 1) milliseconds. One task of Spark
    walks one queue, as each step depends on the last.
    """
    most = window_size(bdp, chunk)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        left = dict(zip(pdf["task"].tolist(), pdf["failures"].tolist(), strict=True))
        fresh, tries = sorted(left), dict.fromkeys(left, 0)
        ready, waiting, flying, out, now, i = [], [], [], [], 0, 0
        while i < len(fresh) or ready or waiting or flying:
            for t in flying:
                if left[t] > 0:
                    left[t] -= 1
                    heapq.heappush(waiting, (now + BACKOFF * 2 ** (tries[t] - 1), t))
            flying = []
            while waiting and waiting[0][0] <= now:
                heapq.heappush(ready, heapq.heappop(waiting)[1])
            while len(flying) < most and (ready or i < len(fresh)):
                if ready:
                    t = heapq.heappop(ready)
                else:
                    t, i = fresh[i], i + 1
                tries[t] += 1
                flying.append(t)
                out.append((len(out), t, tries[t], now, left[t] <= 0))
            now = now + step if flying or not waiting else max(now + step, waiting[0][0])
        cols = list(zip(*out, strict=True))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(out), "seq": cols[0], "task": cols[1], "attempt": cols[2], "at": cols[3], "done": cols[4]})

    rows = tasks.select(group, F.col("task").cast("long").alias("task"), F.col("failures").cast("long").alias("failures"))
    kind = rows.schema[group].dataType.simpleString()
    return rows.groupBy(group).applyInPandas(walk, f"{group} {kind}, seq long, task long, attempt long, at long, done boolean")


def candidates(groups: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """The volume groups that may be chosen: those named, all if none is."""
    return groups.where(F.col(name).isin(*wanted)) if wanted else groups


def longest_first(df: DataFrame, column: str) -> DataFrame:
    """df with ``rank``, 0 for the longest text, of equally long ones the least; a number and not an order of rows, which none has. Rows are dealt by ranges of that order and numbered from where their range begins, so that no task has all."""
    order = [F.desc(F.length(column)), F.asc(column)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(1)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    number = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return dealt.withColumn("rank", number).join(F.broadcast(starts), "range_").withColumn("rank", (F.col("rank") + F.col("start_")).cast("long")).drop("range_", "start_")


def signature_cache(steps: DataFrame, group: str, order: str, ttl: float, keep: int) -> DataFrame:
    """(group, order, hit, why): what a cache answers to a sequence of lookups (group, order, key, at, size).

    A lookup hits if its key was stored with the same size and used within ttl
    seconds; a hit refreshes it. Otherwise, why: "miss", "expired" or "size",
    and the key is stored anew; of more than ``keep`` keys the one used longest
    ago goes.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, out = pdf.sort_values(order), OrderedDict(), []
        for key, at, size in zip(pdf["key"].tolist(), pdf["at"].tolist(), pdf["size"].tolist(), strict=True):
            was = held.pop(key, None)
            why = "miss" if was is None else "expired" if at - was[1] > ttl else "size" if was[0] != size else None
            held[key] = (size, at)
            if len(held) > keep:
                held.popitem(last=False)
            out.append(why)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "hit": [w is None for w in out], "why": out})

    rows = steps.select(group, order, "key", F.col("at").cast("double").alias("at"), F.col("size").cast("long").alias("size"))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (group, order)]
    return rows.groupBy(group).applyInPandas(walk, f"{kinds[0]}, {kinds[1]}, hit boolean, why string")


def compress_chunks(chunks: DataFrame, threshold: float = 0.9, level: int = 3) -> DataFrame:
    """chunks (any columns, data) with algorithm and packed: zstd where the first 8 KiB shrink below the threshold, else "none" and the data as they are. Empty chunks are left as they are."""
    out = T.StructType([*chunks.schema.fields, T.StructField("algorithm", T.StringType()), T.StructField("packed", T.BinaryType())])
    at, names = chunks.columns.index("data"), out.names

    def run(batches):
        z = zstandard.ZstdCompressor(level=level)
        for b in batches:
            got = []
            for x in b.column(at).to_pylist():
                small = bool(x) and len(z.compress(x[:SAMPLE])) / len(x[:SAMPLE]) < threshold
                got.append(("zstd", z.compress(x)) if small else ("none", x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], names)

    return chunks.mapInArrow(run, out)


def expand_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (algorithm, packed) with what they were as ``restored``."""

    @F.pandas_udf(T.BinaryType())
    def expand(algorithm: pd.Series, packed: pd.Series) -> pd.Series:
        z = zstandard.ZstdDecompressor()
        return pd.Series([z.decompress(bytes(x)) if a == "zstd" else x for a, x in zip(algorithm, packed, strict=True)])

    return chunks.withColumn("restored", expand("algorithm", "packed"))
