"""Benchmark decontamination: which texts contain at least 80 % of a test item's shingles.

A size-partitioned containment search with bottom-k MinHash sketches. Items are
put in classes by size (powers of two), and each class has the sketch size that
no qualifying text can miss: a text that holds ceil(.8 n) of an item's n
shingles misses at most n - ceil(.8 n) of them, so it holds one of the
n - ceil(.8 n) + 1 least hashes, however long it is. A shared sketch value makes
a candidate; exact containment of all the item's shingles decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, Chunk, id_column, over_chunks, packed, settle, signed, with_columns, with_text_kind

#: Shingles of the items that one pass over the texts holds; more items take more passes.
BLOCK_SHINGLES = 1 << 23


class Index:
    """Sketches and sets of a block of items."""

    def __init__(self, ids: pa.Array, sets: list[np.ndarray], words: np.ndarray, k: int, percent: int):
        self.ids, self.words, self.k, self.percent = ids, words, k, percent
        hs, at = [], []
        for i, s in enumerate(sets):
            upper = (1 << int(len(s)).bit_length()) - 1
            size = upper + (-upper * percent // 100) + 1
            hs.append(s[:size])
            at.append(np.full(len(hs[-1]), i))
        h, at = np.concatenate([np.zeros(0, U), *hs]), np.concatenate([np.zeros(0, np.int64), *at])
        order = np.argsort(h, kind="stable")
        self.h, self.at = h[order], at[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.h >> U(44)).astype(np.int64)] = True
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, U), *sets])
        self.short = sorted({int(w) for w in words if 0 < w < k})

    def find(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of the chunk, item, shared shingles) of each match."""
        h, off = c.shingle_sets(self.k)
        near = np.flatnonzero(self.bits[(h >> U(44)).astype(np.int64)])
        out = [self._verify(h, off, near)]
        if self.short:
            wh = c.word_hashes(True)
            for w in self.short:  # items of fewer words than a shingle: their whole sequence, anywhere
                sh, at = c.shingles(wh, w)
                doc = c.wdoc[at]
                order = np.lexsort((sh, doc))
                sh, doc = sh[order], doc[order]
                out.append(self._verify(sh, np.searchsorted(doc, np.arange(c.n + 1)), np.flatnonzero(self.bits[(sh >> U(44)).astype(np.int64)]), w))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _verify(self, h, off, near, short=None):
        lo, hi = np.searchsorted(self.h, h[near], "left"), np.searchsorted(self.h, h[near], "right")
        near, lo, n = near[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        doc = np.repeat(np.searchsorted(off, near, "right") - 1, n)
        item = self.at[np.repeat(lo, n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)]
        fits = self.words[item] == short if short else self.words[item] >= self.k
        pair = np.unique(doc[fits] * len(self.words) + item[fits])
        doc, item = pair // max(1, len(self.words)), pair % max(1, len(self.words))
        shared = np.zeros(len(doc), np.int64)
        if len(doc):
            # Hashes by rank, so that a text and a hash are one number; all pairs of about a million shingles at once.
            ranks = np.unique(h)
            own = np.repeat(np.arange(len(off) - 1), np.diff(off)) * len(ranks) + np.searchsorted(ranks, h)
            ends = np.cumsum(self.sizes[item])
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)), len(doc)))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                n = self.sizes[item[lo:hi]]
                at = np.repeat(self.first[item[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                s = self.flat[at]
                r = np.minimum(np.searchsorted(ranks, s), len(ranks) - 1)
                key = np.repeat(doc[lo:hi], n) * len(ranks) + r
                hit = (ranks[r] == s) & (own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key)
                shared[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n), hit, hi - lo)
        keep = 100 * shared >= self.percent * self.sizes[item]
        return doc[keep], item[keep], shared[keep]


def indexes(items: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES):
    """An Index of each block of items (item_id, text), of about so many shingles; items without a word are in none."""

    def rows(c):
        h, off = c.shingle_sets(k)
        short = np.flatnonzero((c.n_words > 0) & (c.n_words < k))
        sets = {int(i): h[off[i] : off[i + 1]] for i in range(c.n)}
        wh = c.word_hashes(True)
        for i in short:
            w = int(c.n_words[i])
            sh, at = c.shingles(wh, w)
            sets[int(i)] = sh[at == c.woff[i]]
        yield {"item_id": id_column(c, "item_id"), "n": [len(sets[i]) for i in range(c.n)], "words": c.n_words, "h": pa.array([sets[i].tobytes() for i in range(c.n)], pa.binary())}

    table = settle(over_chunks(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), rows, "item_id long, n long, words long, h binary").where("n > 0").dropDuplicates(["item_id", "h"]))
    total = table.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-2 * total // block) if total > block else 1
    for b in range(n_blocks):
        got = table.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(n_blocks)) == b).orderBy("item_id", "h").collect()
        yield Index(pa.array([r.item_id for r in got], pa.int64()), [np.frombuffer(r.h, U) for r in got], np.array([r.words for r in got], np.int64), k, percent)


def find_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) for each text that contains an item.

    100 * n_shared >= percent * n_item, over distinct k-word shingles with A-Z
    folded; items of fewer than k words count as found where their whole word
    sequence occurs. Null and empty texts or items match nothing; an item_id of
    null stays null; very long texts are read whole; repeated rows are matched each; empty tables give
    none; other columns are ignored.
    """
    docs = with_text_kind(docs).select("doc_id", "text")
    out = None
    for index in indexes(items, k, percent, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(c, shared=shared):
            x = shared.value
            d, i, n = x.find(c)
            yield {"doc_id": id_column(c).take(pa.array(d)), "item_id": x.ids.take(pa.array(i)), "n_item": x.sizes[i], "n_shared": n}

        part = over_chunks(docs, rows, "doc_id long, item_id long, n_item long, n_shared long")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that contain an item, found as by ``find_items``.

    Null and empty texts contain nothing and stay; very long texts are read
    whole; repeated rows all stay or all go. All columns come back as they were,
    whatever their names; an empty table stays empty, and without items nothing
    goes.
    """
    rows, back = packed(docs)
    for index in indexes(items, k, percent):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        rows = with_columns(rows, lambda c, s=shared: {"n_leaks_": np.bincount(s.value.find(c)[0], minlength=c.n)}, "n_leaks_ long").where("n_leaks_ = 0").drop("n_leaks_")
    return rows.select(*back)
