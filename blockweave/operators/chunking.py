"""Fixed, content-defined and hybrid chunks of volumes."""

from __future__ import annotations

import random
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import holding

#: 256 words of 64 bits, drawn by a fixed seed.
GEAR_SEED = 1


def blocks(vol: DataFrame, size: int) -> DataFrame:
    """(volume columns, seq, offset, length, data) of fixed blocks; a short tail keeps its length, an empty volume has none."""
    n = F.ceil(F.octet_length("data") / size)
    out = vol.withColumn("seq", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda x: x < n)))
    out = out.withColumn("offset", F.col("seq") * size).withColumn("data", F.substr("data", (F.col("offset") + 1).cast("int"), F.lit(size)))
    return out.withColumn("length", F.octet_length("data"))


def blocks_of_parts(parts: DataFrame, size: int) -> DataFrame:
    """(volume_id, seq, offset, length, data) of volumes that come in parts (volume_id, start, data): as large as they like, where one cell holds 2 GiB at most, and a part is cut by one task. Parts but the last are whole numbers of blocks; a part that begins elsewhere is an error."""
    at = F.when(F.col("start") % size != 0, F.raise_error(F.lit("a part must begin where a block does")).cast("long")).otherwise(F.col("start"))
    cut = blocks(parts.select("volume_id", at.cast("long").alias("start"), "data"), size)
    return cut.select("volume_id", (F.floor(F.col("start") / size) + F.col("seq")).alias("seq"), (F.col("start") + F.col("offset")).alias("offset"), "length", "data")


def is_zero(data):
    """All bytes are 0; true of no bytes. A text without any other character is all that trimming zeros leaves nothing of, so nothing is built to compare with."""
    return F.octet_length(F.btrim(data, F.lit(b"\x00"))) == 0


def holes(blocks: DataFrame, extents: DataFrame, width: int) -> DataFrame:
    """blocks (volume_id, offset, length) with ``hole``: whether no extent of data (volume_id, start, end) reaches into them, so that they need not be read. A block is touched if its first byte is in an extent, or an extent's first byte in it: two equi-joins by aligned intervals, so an extent of any length is a few rows."""
    b = blocks.where("length > 0").select("volume_id", "offset", "length")
    e = extents.where(F.col("end") > F.col("start")).select("volume_id", "start", "end")
    inside = holding(b.select("volume_id", "offset"), "offset", e, ["volume_id"], width).select("volume_id", "offset")
    begun = holding(e.select("volume_id", F.col("start").alias("first")), "first", b.select("volume_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end")), ["volume_id"], width).select("volume_id", F.col("start_").alias("offset"))
    hit = inside.union(begun).distinct().withColumn("data_", F.lit(True))
    return blocks.join(hit, ["volume_id", "offset"], "left").withColumn("hole", F.col("data_").isNull()).drop("data_")


def read_exact(vol: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(volume_id, offset, data, problem) of wanted offsets (volume_id, offset) with ``size`` bytes each. problem: "bounds" for an offset below 0, or one that with the block passes 2**63 - 1; "short" where the volume has fewer bytes there; such a read has no data. A tail is short here, unlike in ``blocks``."""
    got = wanted.join(vol.select("volume_id", "data"), "volume_id", "left")
    bounds = (F.col("offset") < 0) | (F.col("offset") > (1 << 63) - 1 - size)
    short = F.coalesce(F.octet_length("data"), F.lit(0)) < F.col("offset") + size
    problem = F.when(bounds, "bounds").when(short, "short")
    data = F.when(problem.isNull(), F.substr("data", (F.col("offset") + 1).cast("int"), F.lit(size)))
    return got.select("volume_id", "offset", data.alias("data"), problem.alias("problem"))


def unconfirmed(blocks: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """blocks (volume_id, seq, length) that a bitmap of confirmed ones (volume_id, seq) lacks, with problem "short" for a tail of fewer than ``size`` bytes.

    The bitmap is built by Spark's bitmap aggregates, a word of 32768 blocks at a
    time, so what is joined are words and not blocks.
    """
    words = done.groupBy("volume_id", F.bitmap_bucket_number("seq").alias("word_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq")).alias("bits_"))
    got = blocks.withColumns({"word_": F.bitmap_bucket_number("seq"), "at_": F.bitmap_bit_position("seq").cast("int")}).join(words, ["volume_id", "word_"], "left")
    byte = F.conv(F.hex(F.substr("bits_", F.floor(F.col("at_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("at_") % 8)) % 2, F.lit(0))
    out = got.where(bit == 0).drop("word_", "at_", "bits_")
    return out.withColumn("problem", F.when(F.col("length") != size, "short"))


def gear(seed: int = 0) -> np.ndarray:
    r = random.Random(GEAR_SEED)
    return np.array([r.getrandbits(64) for _ in range(256)], np.uint64) ^ np.uint64(seed)


class Cutter:
    """Content-defined cuts.

    A cut needs the low bits of a hash that takes in a byte by shift and add, so
    those bits see only as many bytes as the mask is wide: candidates of a whole
    volume are found by array operations, and only they are looked at one by
    one. The wider mask holds where the last 64 bytes have under 4 bits of
    entropy.
    """

    def __init__(self, low: int, avg: int, high: int, seed: int = 0):
        if low < 64 or not low <= avg <= high:
            raise ValueError("sizes must be 64 <= low <= avg <= high")
        self.low, self.high, self.table = low, high, gear(seed)
        bits = max(1, int(np.log2(avg)))
        self.width, self.normal, self.wide = bits + 2, np.uint64((1 << bits) - 1), np.uint64((1 << (bits + 2)) - 1)

    def _rich(self, data: np.ndarray, end: int) -> bool:
        n = np.bincount(data[max(0, end - 64) : end])
        n = n[n > 0]
        return float((n * np.log2(n)).sum()) <= 128 + 1e-9

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """The hash after each byte, as far as the masks see it."""
        g = self.table[data]
        h = g.copy()
        for j in range(1, self.width):
            h[j:] += g[:-j] << np.uint64(j) if j < len(data) else 0
        return h

    def cuts(self, data: np.ndarray) -> list[int]:
        """Ends of the chunks."""
        size, out, at = len(data), [], 0
        h = self.hashes(data)
        found = np.flatnonzero((h & self.normal) == 0)
        maybe, sure = found.tolist(), ((h[found] & self.wide) == 0).tolist()
        shifts = np.arange(1, self.width, dtype=np.uint64)
        while at < size:
            first, stop = at + self.low, min(size, at + self.high)
            if first >= size:
                out.append(size)
                break
            end = None
            # The hash starts anew after the least size: what earlier bytes add to the first values is taken off.
            last = min(stop, first + self.width - 1)
            near = h[first:last] - (h[first - 1] << shifts[: last - first])
            for i in np.flatnonzero((near & self.normal) == 0).tolist():
                if near[i] & self.wide == 0 or self._rich(data, first + i + 1):
                    end = first + i + 1
                    break
            if end is None:
                for k in range(bisect_left(maybe, last), len(maybe)):
                    p = maybe[k]
                    if p >= stop:
                        break
                    if sure[k] or self._rich(data, p + 1):
                        end = p + 1
                        break
            at = end or stop
            out.append(at)
        return out


def spread(vol: DataFrame, *keys: str) -> DataFrame:
    """vol dealt to all cores where it comes from fewer files than there are cores; with more files the scan is parallel and nothing is shuffled."""
    cores, files = vol.sparkSession.sparkContext.defaultParallelism, len(vol.inputFiles())
    return vol.repartition(cores, *keys) if 0 < files < cores else vol


def cdc_chunks(vol: DataFrame, low: int, avg: int, high: int, seed: int = 0, key: str = "volume_id") -> DataFrame:
    """(key, seq, offset, length, data) of content-defined chunks. One volume is cut by one task: a cut depends on the one before."""
    return _cut(spread(vol.select(key, "data"), key), low, avg, high, seed, [key])


def _cut(vol: DataFrame, low: int, avg: int, high: int, seed: int, keys: list[str]) -> DataFrame:
    rows = vol.select(*keys, "data")
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("seq long, offset long, length int, data binary").fields])
    names = schema.names

    def run(batches):
        cutter = Cutter(low, avg, high, seed)
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(len(keys))[i].as_buffer()
                data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
                ends = cutter.cuts(data)
                starts = [0, *ends[:-1]]
                for lo in range(0, len(ends), 4096):
                    s, e = starts[lo : lo + 4096], ends[lo : lo + 4096]
                    own = [b.column(k).take(pa.array([i] * len(s))) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(range(lo, lo + len(s)), pa.int64()), pa.array(s, pa.int64()), pa.array([y - x for x, y in zip(s, e, strict=True)], pa.int32()), pa.array([data[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary())], names)

    return rows.mapInArrow(run, schema)


def hybrid_chunks(vol: DataFrame, block: int, low: int, avg: int, high: int) -> DataFrame:
    """Content-defined chunks inside each fixed block: blocks are cut in parallel, those of one volume too. (volume_id, block, seq, offset, length, data); a volume_id of any value or type."""
    cut = blocks(vol.select("volume_id", "data"), block).select("volume_id", F.col("seq").alias("block"), "data")
    return _cut(spread(cut, "volume_id", "block"), low, avg, high, 0, ["volume_id", "block"]).select("volume_id", "block", "seq", (F.col("block") * block + F.col("offset")).alias("offset"), "length", "data")


def dedup_refs(chunks: DataFrame) -> DataFrame:
    """(volume_id, offset, length, ref_volume, ref_offset): chunks (volume_id, offset, length, digest) whose content came before, and where it stands first."""
    first = chunks.groupBy("digest").agg(F.min(F.struct("volume_id", "offset")).alias("first"))
    return chunks.join(first, "digest").where(F.col("first") < F.struct("volume_id", "offset")).select("volume_id", "offset", "length", F.col("first.volume_id").alias("ref_volume"), F.col("first.offset").alias("ref_offset"))


def size_distribution(chunks: DataFrame, avg: int) -> DataFrame:
    """One row: how many chunks, their mean and median length, and how many are shorter and longer than the aim."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean_length"), F.count_if(F.col("length") < avg).alias("n_below"), F.count_if(F.col("length") > avg).alias("n_above"), F.expr("percentile(length, 0.5)").alias("median_length"))
