"""Hard negatives by a pivot table.

Each vector x gets one entry more, the root of M**2 - |x|**2 with M the largest
norm; an anchor gets 0 there. The squared distance of the two is then
|q|**2 + M**2 - 2 q.x, so the greatest inner product is the least distance, and
the triangle inequality over stored distances to a few pivots brackets every
score. Rows are stored by their nearest pivot and their distance to it: of a cell
an anchor needs only the rows of one interval, and cells whose bracket cannot
matter are not looked at. What is left is scored exactly in integers.

Anchors come in blocks of bounded size, each against all rows. Two passes find
the positives and then, within the band that each positive sets, the negatives.
A bounded sample of rows gives every anchor a first bound that the true answer
cannot be below, so that brackets cut from the start.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import bound_batches, drop_at_exit, settle, shared_dir, written
from .vectors import EXACT, bits, common_length, entries, product, usable

SCALE = 256
PIVOTS = 16
#: Rows that a task holds and scores at once, anchors scored at once, anchors of one block, rows of the sample.
CHUNK, TILE, BLOCK, SAMPLE = 8192, 512, 16_384, 4_096
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Rows:
    """Integer vectors with ids, labels and row numbers; an id of 2**63 - 1 stands for null."""

    def __init__(self, x, ids, labels, rows):
        self.x, self.ids, self.labels, self.rows = x, ids, labels, rows

    def at(self, i) -> Rows:
        return Rows(self.x[i], self.ids[i], self.labels[i], self.rows[i])


def _rows(b: pa.RecordBatch, d: int, scale: int, most: int) -> Rows:
    long = lambda n: b.column(b.schema.get_field_index(n)).cast(pa.int64())
    return Rows(entries(b.column(b.schema.get_field_index("v_")), d, scale, 0, most), long("id_").fill_null(NO_ID).to_numpy(), long("label_").to_numpy(), long("row_").to_numpy())


class Pivots:
    """Distances of vectors, one entry longer, to the pivots, and the slack that covers their rounding."""

    def __init__(self, sample: np.ndarray, most: int, n: int = PIVOTS):
        self.most = float(most)
        x, norms = sample.astype(np.float64), (sample.astype(np.float64) ** 2).sum(axis=1)
        chosen = [int(norms.argmax())]
        near = np.full(len(x), np.inf)
        while len(chosen) < min(n, len(x)):  # the one furthest from those chosen
            p = x[chosen[-1]]
            near = np.minimum(near, ((x - p) ** 2).sum(axis=1))
            chosen.append(int(near.argmax()))
        self.p, self.norms = x[chosen], norms[chosen]
        self.extra = np.sqrt(np.maximum(0, self.most - self.norms))
        #: Rounding of a squared distance, generously.
        self.slack = 1e-9 * max(1.0, self.most)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float64)
        extra = np.sqrt(np.maximum(0, self.most - (f * f).sum(axis=1)))
        return np.sqrt(np.maximum(0, 2 * self.most - 2 * (f @ self.p.T + extra[:, None] * self.extra)))

    def of_anchors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, |q|**2 + M**2): the entry added to an anchor is 0."""
        f = x.astype(np.float64)
        both = (f * f).sum(axis=1) + self.most
        return np.sqrt(np.maximum(0, both[:, None] - 2 * f @ self.p.T)), both


class Best:
    """For each slot the best few (score, id), higher scores and then smaller ids first."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot = self.score = self.id = self.row = np.zeros(0, np.int64)
        self.last = np.full(slots, NONE, np.int64)

    def add(self, slot, score, ids, rows) -> None:
        slot, score, ids, rows = (np.concatenate([a, b]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, np.arange(self.slots))
        place = np.arange(len(slot)) - first[slot]
        kept = order[place < self.k]
        self.slot, self.score, self.id, self.row = slot[place < self.k], score[kept], ids[kept], rows[kept]
        full = place == self.k - 1
        self.last[slot[full]] = score[order[full]]


def _tops(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of each anchor's k best scores among those that are ok; rows stand by id, so of equal scores the first are best."""
    a, r = np.nonzero(ok)
    if len(a) > k * len(s):
        order = np.lexsort((r, -s[a, r], a))
        a, r = a[order], r[order]
        place = np.arange(len(a)) - np.searchsorted(a, np.arange(len(s)))[a]
        a, r = a[place < k], r[place < k]
    return a, r


class Search:
    """One block of anchors against chunks of rows."""

    def __init__(self, anchors: Rows, pivots: Pivots, low: np.ndarray | None, high: np.ndarray | None, k: int):
        """low and high: bounds of the wanted scores, (anchors, bands) each; without them the best of the same label are wanted."""
        self.anchors, self.pivots, self.k, self.same = anchors, pivots, k, low is None
        n = len(anchors.ids)
        self.bands = 1 if self.same else low.shape[1]
        self.low = np.full((n, 1), NONE) if self.same else low
        self.high = np.full((n, 1), NO_ID) if self.same else high
        self.far, self.both = pivots.of_anchors(anchors.x)
        self.best = Best(n * self.bands, k)
        self.bound = self.low.copy()  # what a score must reach

    def raise_bounds(self, last: np.ndarray) -> None:
        self.bound = np.maximum(self.bound, last.reshape(self.bound.shape))

    def chunk(self, rows: Rows, far: np.ndarray) -> None:
        near = far.argmin(axis=1)
        order = np.lexsort((far[np.arange(len(near)), near], near))
        edges = np.searchsorted(near[order], np.arange(far.shape[1] + 1))
        cells = [(p, order[edges[p] : edges[p + 1]]) for p in range(far.shape[1]) if edges[p] < edges[p + 1]]
        spans = [(far[c].min(axis=0), far[c].max(axis=0)) for _, c in cells]
        limits = bits(self.anchors.x) + bits(rows.x) + rows.x.shape[1].bit_length()
        floats = rows.x.astype(np.float64) if limits < EXACT.bit_length() - 1 else None
        for lo in range(0, len(self.anchors.ids), TILE):
            tile = slice(lo, lo + TILE)
            found = [self._cell(tile, rows, far, floats, p, c, span) for (p, c), span in zip(cells, spans, strict=True)]
            found = [f for f in found if f is not None]
            if found:
                self.best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
                self.raise_bounds(self.best.last)

    def _cell(self, tile, rows, far, floats, p, cell, span):
        s, both, slack = self.far[tile], self.both[tile], self.pivots.slack
        with np.errstate(invalid="ignore"):
            need = self.bound[tile].min(axis=1).astype(np.float64)  # least score that any band wants
            most = self.high[tile].max(axis=1).astype(np.float64)
        # Brackets of the cell's scores, over all pivots.
        nearest = np.maximum(0, np.maximum(s - span[1], span[0] - s)).max(axis=1)
        furthest = (s + span[1]).min(axis=1)
        above, below = (both - nearest**2) / 2 + slack, (both - furthest**2) / 2 - slack
        want = np.flatnonzero((above >= need) & (below <= most) & (self.high[tile] >= self.bound[tile]).any(axis=1))
        if not len(want):
            return None
        # Of the cell's rows, by distance to its pivot, an anchor needs those within one interval.
        reach = np.sqrt(np.maximum(0, both[want] - 2 * need[want] + 2 * slack))
        own = far[cell, p]
        first, last = np.searchsorted(own, s[want, p] - reach - 1e-6 * (1 + reach)), np.searchsorted(own, s[want, p] + reach + 1e-6 * (1 + reach), "right")
        want, first, last = want[first < last], first[first < last], last[first < last]
        if not len(want):
            return None
        c = cell[first.min() : last.max()]
        c = c[np.lexsort((rows.rows[c], rows.ids[c]))]
        at = want + tile.start
        if floats is not None:
            scores = np.rint(self.anchors.x[at].astype(np.float64) @ floats[c].T).astype(np.int64)
        else:
            scores = product(self.anchors.x[at], rows.x[c].T).astype(np.int64)
        alike = self.anchors.labels[at][:, None] == rows.labels[c]
        if self.same:
            ok = alike & (self.anchors.rows[at][:, None] != rows.rows[c])
        else:
            ok = ~alike
        out = []
        for band in range(self.bands):
            hit = ok & (scores >= self.bound[at, band][:, None]) & (scores <= self.high[at, band][:, None])
            if hit.any():
                a, r = _tops(scores, hit, self.k)
                out.append((at[a] * self.bands + band, scores[a, r], rows.ids[c[r]], rows.rows[c[r]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None


def _run(table: DataFrame, d: int, scale: int, most: int, pivots: Pivots, anchors: Rows, low, high, k: int, start: np.ndarray) -> DataFrame:
    """(slot, score, id, row) of each task's best, from which the best of all are the first k by slot."""
    sent = table.sparkSession.sparkContext.broadcast((pivots, anchors, low, high, start))

    def run(batches):
        pivots, anchors, low, high, start = sent.value
        search = Search(anchors, pivots, low, high, k)
        search.raise_bounds(start)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                far = part.column(part.schema.get_field_index("far_"))
                search.chunk(_rows(part, d, scale, most), np.asarray(far.flatten()).reshape(part.num_rows, -1))
        t = search.best
        yield pa.RecordBatch.from_arrays([pa.array(t.slot), pa.array(t.score), pa.array(t.id), pa.array(t.row)], ["slot", "score", "id", "row"])

    got = table.mapInArrow(run, "slot long, score long, id long, row long")
    first = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "row")
    return got.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: Column | None = None, label: Column | str = "label", column: str = "embedding", id: str = "vec_id", scale: int = SCALE, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of each anchor and positive, as (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Entries are floor(scale * c); a score is the integer inner product with the
    anchor, higher first, ties by smaller id. An anchor's positives are its first
    ``n_positives`` other rows of its label; a positive's negatives the first
    ``n_negatives`` rows of other labels whose score is between low and high
    percent of the positive's. anchors: which rows are anchors, ids divisible by
    100 if not given.

    Rows without a label, without a vector, with a null or not finite entry, or
    with another number of entries than most vectors, take no part. A null id is
    no anchor, but may be found and comes last in ties; repeated rows are rows of
    their own. Entries stop where scores could pass a long, at 2**27 for 64
    dimensions. An anchor without positives or negatives, and an empty table, give
    no rows. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    name = F.col(f"`{id}`").cast("long")
    lab = (F.col(label) if isinstance(label, str) else label).cast("long")
    is_anchor = name % 100 == 0 if anchors is None else anchors
    rows = vectors.select(name.alias("id_"), lab.alias("label_"), F.coalesce(is_anchor & name.isNotNull(), F.lit(False)).alias("anchor_"), F.col(f"`{column}`").alias("v_"))
    rows = rows.where("label_ is not null").where(usable("v_"))
    d = common_length(rows, "v_")
    if not d:
        return spark.createDataFrame([], RESULT)
    most = 1 << ((62 - d.bit_length()) // 2)
    rows = settle(rows.where(F.size("v_") == d).withColumn("row_", F.monotonically_increasing_id()))
    sample = _collected(rows.orderBy(F.xxhash64("id_", "row_")).limit(SAMPLE), d, scale, most)
    norm = rows.select(F.aggregate("v_", F.lit(0.0), lambda a, x: a + F.pow(F.least(F.lit(float(most)), F.abs(F.floor(x.cast("double") * scale))), F.lit(2))).alias("n")).agg(F.max("n")).head()[0]
    pivots = Pivots(sample.x, norm * (1 + 1e-12) + 1)

    def far(batches):
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                x = pivots.of_rows(_rows(part, d, scale, most).x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "far_"])

    from pyspark.sql import types as T

    table = written(rows.mapInArrow(far, T.StructType([*rows.schema.fields, T.StructField("far_", T.ArrayType(T.DoubleType()))])))
    n = table.where("anchor_").count()
    blocks = -(-n // BLOCK)
    if not n:
        return spark.createDataFrame([], RESULT)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    for k in range(blocks):
        block = _collected(table.where("anchor_").where(F.pmod(F.xxhash64("row_"), F.lit(blocks)) == k), d, scale, most)
        if len(block.ids):
            _block(table, block, sample, pivots, d, scale, most, n_positives, n_negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _collected(rows: DataFrame, d: int, scale: int, most: int) -> Rows:
    got = rows.select("id_", "label_", "row_", "v_").toArrow().combine_chunks().to_batches()
    return _rows(got[0], d, scale, most) if got else Rows(np.zeros((0, d), np.int64), *[np.zeros(0, np.int64)] * 3)


def _start(sample: Rows, pivots: Pivots, anchors: Rows, low, high, k: int) -> np.ndarray:
    """For each slot the k-th best score within the sample: the true one is not below it."""
    search = Search(anchors, pivots, low, high, k)
    search.chunk(sample, pivots.of_rows(sample.x))
    return search.best.last


def _block(table, anchors, sample, pivots, d, scale, most, n_positives, n_negatives, low, high) -> DataFrame:
    spark, n = table.sparkSession, len(anchors.ids)
    slim = table.select("id_", "label_", "row_", "v_", "far_")
    near = _run(slim, d, scale, most, pivots, anchors, None, None, n_positives, _start(sample, pivots, anchors, None, None, n_positives)).collect()
    pos = np.full((n, n_positives), NONE, np.int64)
    ids = np.full((n, n_positives), NO_ID, np.int64)
    for r in near:
        pos[r["slot"], r["place"] - 1], ids[r["slot"], r["place"] - 1] = r["score"], r["id"]
    none = pos == NONE
    safe = np.where(none, 0, pos).astype(object)
    least, top = -(-(low * safe) // 100), (high * safe) // 100
    least, top = np.where(none, NO_ID, least).astype(np.int64), np.where(none, NONE, top).astype(np.int64)
    least, top = np.where(least > top, NO_ID, least), np.where(least > top, NONE, top)  # an empty band
    got = _run(slim, d, scale, most, pivots, anchors, least, top, n_negatives, _start(sample, pivots, anchors, least, top, n_negatives))
    pairs = pa.table({"slot": np.arange(n * n_positives), "a": np.repeat(anchors.ids, n_positives), "p": ids.ravel(), "s": pos.ravel()})
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = got.join(F.broadcast(spark.createDataFrame(pairs)), "slot")
    return out.select(F.col("a").alias("anchor_id"), known("p").alias("positive_id"), F.col("place").cast("int").alias("rank"), known("id").alias("negative_id"), F.col("s").alias("positive_score"), F.col("score").alias("negative_score"))
