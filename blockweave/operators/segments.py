"""Content-defined chunks of volumes in parts: one volume is cut by many tasks, byte for byte as one task would.

A cut depends on the one before, but walks from different starts soon fall in
step. So each segment of a volume answers, by array operations, where a walk that
enters it at any possible place leaves it, and after how many chunks; entries
that do alike are one row. A pass over those few rows follows each volume from
byte 0, and then all segments are cut at once from their true entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.volumes import bound_batches
from .chunking import Cutter

_WINDOW = 64
_LOGS = np.concatenate([np.zeros(1), np.arange(1, _WINDOW + 1) * np.log2(np.arange(1, _WINDOW + 1))])


def parts(vol: DataFrame, size: int, key: str = "volume_id") -> DataFrame:
    """(key, start, data): volumes (key, data) in parts of ``size`` bytes, the last one shorter; a volume without bytes is one empty part."""
    n = F.greatest(F.ceil(F.octet_length("data") / size), F.lit(1).cast("long"))
    out = vol.select(key, "data", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i_"))
    start = F.col("i_") * size
    return out.select(key, start.alias("start"), F.substr("data", (start + 1).cast("int"), F.lit(size)).alias("data"))


def segments(pieces: DataFrame, size: int, over: int, key: str = "volume_id") -> DataFrame:
    """(key, seg, data): each volume's bytes from seg * size on, ``size`` of them and ``over`` more of what follows, as an array of strings end to end. pieces: (key, start, data), without gaps or overlaps, cut anywhere. Each byte is shuffled once, those that two segments need twice."""
    end = F.col("start") + F.octet_length("data")
    first, last = F.floor(F.greatest(F.col("start") - over, F.lit(0)) / size), F.floor((end - 1) / size)
    at = pieces.where(F.octet_length("data") > 0).withColumn("seg", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo = F.greatest(F.col("start"), F.col("seg") * size)
    hi = F.least(end, (F.col("seg") + 1) * size + over)
    cut = at.select(key, "seg", lo.alias("lo_"), F.substr("data", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("d_")).where(F.octet_length("d_") > 0)
    cells = F.array_sort(F.collect_list(F.struct("lo_", "d_")))
    whole = cut.groupBy(key, "seg").agg(cells.alias("c_"), F.sum(F.octet_length("d_")).alias("n_"))
    last = F.element_at("c_", -1)
    held = (F.col("c_")[0]["lo_"] == F.col("seg") * size) & (last["lo_"] + F.octet_length(last["d_"]) == F.col("seg") * size + F.col("n_"))
    return whole.select(key, "seg", F.when(held, F.transform("c_", lambda c: c["d_"])).otherwise(F.raise_error(F.lit("the parts of a volume overlap or leave a gap")).cast("array<binary>")).alias("data"))


def _bytes(lists: pa.ListArray, i: int) -> np.ndarray:
    """The strings of one list, end to end: Arrow holds them so."""
    values = lists.values
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset :]
    at = lists.offsets[i].as_py(), lists.offsets[i + 1].as_py()
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[at[0]] : ends[at[1]]]


class Walk:
    """One segment's bytes, asked where chunks that begin at given places end."""

    def __init__(self, cutter: Cutter, data: np.ndarray):
        self.c, self.data, self.size = cutter, data, len(data)
        self.h = cutter.hashes(data)
        found = np.flatnonzero((self.h & cutter.normal) == 0)
        found = found[found >= _WINDOW]
        sure = (self.h[found] & cutter.wide) == 0
        sure[~sure] = self.poor(found[~sure] + 1)
        self.accepted = found[sure]

    def poor(self, ends: np.ndarray) -> np.ndarray:
        """Whether the 64 bytes before each end have 4 bits of entropy at least, so that the narrower mask holds."""
        out = np.zeros(len(ends), bool)
        for lo in range(0, len(ends), 4096):
            e = ends[lo : lo + 4096]
            w = self.data[e[:, None] - np.arange(1, _WINDOW + 1)].astype(np.int64) + 256 * np.arange(len(e))[:, None]
            counts = np.bincount(w.ravel(), minlength=256 * len(e)).reshape(len(e), 256)
            out[lo : lo + 4096] = _LOGS[counts].sum(axis=1) <= 128 + 1e-9
        return out

    def ends(self, at: np.ndarray) -> np.ndarray:
        """Ends of the chunks that begin at these places."""
        c = self.c
        first, stop = at + c.low, np.minimum(self.size, at + c.high)
        out = stop.copy()
        last = np.minimum(stop, first + c.width - 1)
        i = np.searchsorted(self.accepted, last)
        near = self.accepted[np.minimum(i, len(self.accepted) - 1)] if len(self.accepted) else np.full(len(at), self.size)
        ok = (i < len(self.accepted)) & (near < stop)
        out[ok] = near[ok] + 1
        # The hash starts anew after the least size: places whose first values are a cut, the nearest last so that it stays.
        for k in range(c.width - 2, -1, -1):
            p = first + k
            on = np.flatnonzero(p < last)
            value = self.h[p[on]] - (self.h[first[on] - 1] << np.uint64(k + 1))
            on, value = on[(value & c.normal) == 0], value[(value & c.normal) == 0]
            sure = (value & c.wide) == 0
            sure[~sure] = self.poor(p[on[~sure]] + 1)
            out[on[sure]] = p[on[sure]] + 1
        return np.where(first >= self.size, self.size, out)

    def leaves(self, entries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(the first cut from ``limit`` on, chunks until there) of walks from these entries.

        Those furthest behind go on first: a chunk has ``low`` bytes at least, so
        walks that come to one place meet there, and are followed once from then.
        """
        at, n = entries.astype(np.int64), np.zeros(len(entries), np.int64)
        walks, met = np.arange(len(at)), []
        while True:
            walks = walks[at[walks] < limit]
            if not len(walks):
                break
            if len(walks) == 1:
                w = int(walks[0])
                ends = np.array(self.c.cuts(self.data[at[w] :])) + at[w]
                k = int(np.searchsorted(ends, limit))
                at[w], n[w] = ends[min(k, len(ends) - 1)], n[w] + min(k, len(ends) - 1) + 1
                break
            behind = walks[at[walks] < at[walks].min() + self.c.low]
            at[behind], n[behind] = self.ends(at[behind]), n[behind] + 1
            _, one, same = np.unique(at[walks], return_index=True, return_inverse=True)
            leader = walks[one][same]
            rest = leader != walks
            if rest.any():
                met.append((walks[rest], leader[rest], n[walks[rest]] - n[leader[rest]]))
                walks = walks[~rest]
        for w, leader, more in reversed(met):
            at[w], n[w] = at[leader], n[leader] + more
        return at, n


def cdc_chunks_of_parts(pieces: DataFrame, low: int, avg: int, high: int, segment: int = 1 << 25, seed: int = 0) -> DataFrame:
    """(volume_id, seq, offset, length, data) of the content-defined chunks of volumes in parts (volume_id, start, data), as ``cdc_chunks`` cuts them.

    A segment must have ``high`` bytes at least; memory is that of a few segments
    a task. Repeated parts, or parts that leave a gap, are an error. Empty volumes
    and null parts have no chunks.
    """
    if segment < high:
        raise ValueError(f"a segment of {segment} bytes is less than the longest chunk, {high}")
    key = "key_"  # a struct, so that a null id is a volume like others
    rows = pieces.select(F.struct("volume_id").alias(key), F.col("start").cast("long").alias("start"), "data")
    bound_batches(pieces.sparkSession)
    seg = segments(rows, segment, high, key)
    kind = rows.schema[key].dataType.simpleString()

    def ways(batches):
        cutter = Cutter(low, avg, high, seed)
        for b in batches:
            for i in range(b.num_rows):
                data = _bytes(b.column(2), i)
                first = b.column(1)[i].as_py() == 0
                if first and len(data) <= segment:  # all of its volume
                    continue
                walk = Walk(cutter, data)
                limit = min(segment, len(data))
                entries = np.zeros(1, np.int64) if first else np.arange(min(high, len(data) + 1))
                exits, n = walk.leaves(entries, limit)
                # Entries that leave alike are a run: at the same place, or each at the same distance.
                still = np.r_[False, (np.diff(exits) == 0) & (np.diff(n) == 0)]
                along = np.r_[False, (np.diff(exits) == 1) & (np.diff(n) == 0)]
                begin = np.flatnonzero(~still & ~along | still & np.r_[False, along[:-1]] | along & np.r_[False, still[:-1]])
                moving = along[np.minimum(begin + 1, len(along) - 1)] & (begin + 1 < len(along))
                k = len(begin)
                own = [b.column(c).take(pa.array([i] * k)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(entries[begin]), pa.array(exits[begin]), pa.array(n[begin]), pa.array(moving)], [key, "seg", "from_", "exit_", "n_", "moving_"])

    table = seg.mapInArrow(ways, f"{key} {kind}, seg long, from_ long, exit_ long, n_ long, moving_ boolean")

    def follow(runs: pa.Table) -> pa.Table:
        runs = runs.sort_by([("seg", "ascending"), ("from_", "ascending")])
        seg, first, leaves, n, moving = (runs.column(c).to_numpy() for c in ("seg", "from_", "exit_", "n_", "moving_"))
        begin = np.flatnonzero(np.r_[True, np.diff(seg) > 0])
        if (seg[begin] != np.arange(len(begin))).any():
            raise ValueError("the parts of a volume overlap or leave a gap")
        at, number, entries, numbers = 0, 0, [], []
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(seg)], strict=True):
            entries.append(at)
            numbers.append(number)
            k = lo + int(np.searchsorted(first[lo:hi], at, "right")) - 1
            number += int(n[k])
            at = max(0, int(leaves[k]) + (at - int(first[k]) if moving[k] else 0) - segment)
        return pa.table([runs.column(key).take(pa.array([0] * len(begin))), pa.array(seg[begin]), pa.array(entries, pa.int64()), pa.array(numbers, pa.int64())], [key, "seg", "entry_", "number_"])

    entry = table.groupBy(key).applyInArrow(follow, f"{key} {kind}, seg long, entry_ long, number_ long")

    def cut(batches):
        cutter = Cutter(low, avg, high, seed)
        for b in batches:
            for i in range(b.num_rows):
                s, at, number = (b.column(c)[i].as_py() for c in (1, 2, 3))
                data = _bytes(b.column(4), i)
                if at >= min(segment, len(data)):
                    continue
                ends = np.array(cutter.cuts(data[at:])) + at
                starts = np.r_[at, ends[:-1]]
                mine = starts < segment
                starts, ends = starts[mine], ends[mine]
                for lo in range(0, len(ends), 4096):
                    x, y = starts[lo : lo + 4096], ends[lo : lo + 4096]
                    own = b.column(0).take(pa.array([i] * len(x)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(number + lo + np.arange(len(x))), pa.array(s * segment + x), pa.array((y - x).astype(np.int32)), pa.array([data[p:q].tobytes() for p, q in zip(x, y, strict=True)], pa.binary())], [key, "seq", "offset", "length", "data"])

    begins = F.when((F.col("seg") > 0) & F.col("entry_").isNull(), F.raise_error(F.lit("the parts of a volume overlap or leave a gap")).cast("long")).otherwise(F.coalesce("entry_", F.lit(0).cast("long")))
    known = seg.join(entry, [key, "seg"], "left").select(key, "seg", begins.alias("entry_"), F.coalesce("number_", F.lit(0).cast("long")).alias("number_"), "data")
    out = known.mapInArrow(cut, f"{key} {kind}, seq long, offset long, length int, data binary")
    return out.select(f"{key}.volume_id", "seq", "offset", "length", "data")
