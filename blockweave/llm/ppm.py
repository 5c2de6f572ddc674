"""Scores of texts: a unigram base, and prediction by partial matching over bytes.

The trie of byte contexts has depth 5. Its symbols are all byte values (A-Z
folded, which frees the code of A for the text's end); bytes that no training
text has are alike, and share one symbol that training never sees. A context
escapes to its suffix by method C, (symbols seen) / (count + symbols seen), and
symbols it has seen are excluded below. Every context and symbol that was seen
counts, if only once.

Neither the trie nor the token counts of the base have a bound, so they never
leave the executors. A batch of documents sends each token and each 6-symbol
string it holds once: tokens to fragments of the hash order, strings to that of
their last three context symbols, which so has all longer contexts of these. A
fragment adds up what training texts have, and sends the count of each token or
the log probability of each string back to the batch, which walks its texts
again. Only contexts of up to two symbols are broadcast: as many cells at most
as there are strings of three byte values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import CHUNK_BYTES, Chunk, U, arrow_schema, bound_batches, by_fragment, each_chunk, fragment_of, fragments, id_column, mix, record, settle, written

FLUSH = 1 << 20
#: Symbols of a batch, and strings of a fragment, that are worked on at once.
PIECE = 1 << 20
SYMBOLS, END = 64, 63
DEPTH = 5
#: The end of a text among byte values: A, which folding leaves free.
STOP = 65
#: The counts of short contexts reach the driver in so many blobs.
LOW_PARTS = 8
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _postings(docs: DataFrame, n_frag: int) -> DataFrame:
    """By batch of documents, kind 0: a fragment's tokens; kind 1: the documents; kind 2: a fragment's 6-symbol strings. Of a task, kind 3: counts of 3-symbol strings in training texts."""
    schema = "kind int, frag int, part long, blob binary"
    out = arrow_schema(schema)

    def rows(kind, got, part):
        for i in range(0, len(got), 64):
            some = got[i : i + 64]
            yield record({"kind": [kind] * len(some), "frag": [f for f, _ in some], "part": [part] * len(some), "blob": [b for _, b in some]}, out)

    def run(batches):
        part, parts, docs_, held, n_docs, n_bytes = TaskContext.get().partitionId() << 24, [], [], 0, 0, 0
        low = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush():
            nonlocal low
            h, doc = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            ids, none, train, n_words, lens = (np.concatenate([d[i] for d in docs_]) for i in range(5))
            data = np.concatenate([d[5] for d in docs_])
            yield from rows(1, [(None, _squeeze((ids.view(U), 8), (none, 1), (~train, 1), (n_words, 5), (lens, 5)) + _squeeze((data, 1)))], part)
            k, n = strings_of(data, np.concatenate([[0], np.cumsum(lens)]), train)
            yield from rows(2, [(f, _squeeze((kk, 6), (nn, 4))) for f, kk, nn in by_fragment(_home(k, n_frag), n_frag, k, n)], part)
            seen = n > 0
            low = _added(np.concatenate([low[0], k[seen] & 0xFFFFFF]), np.concatenate([low[1], n[seen]]))
            words, back = np.unique(h, return_inverse=True)
            n = np.bincount(back[train[doc]], minlength=len(words))
            yield from rows(0, [(f, _squeeze((hh, 8), (nn, 4))) for f, hh, nn in by_fragment(fragment_of(words, n_frag), n_frag, words, n)], part)

        for c in each_chunk(batches):
            c.words()
            train = np.asarray(c.rows.column(c.rows.schema.get_field_index("train")).to_numpy(zero_copy_only=False), bool)
            ids = id_column(c)
            parts.append((c.word_hashes(True), c.wdoc + n_docs))
            docs_.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null().to_numpy(zero_copy_only=False)), train, c.n_words, np.diff(c.offs), _FOLD[c.data]))
            held, n_docs, n_bytes = held + len(c.ws), n_docs + c.n, n_bytes + len(c.data)
            if held > FLUSH or n_docs > FLUSH or n_bytes > 4 * FLUSH:
                yield from flush()
                part, parts, docs_, held, n_docs, n_bytes = part + 1, [], [], 0, 0, 0
        if n_docs:
            yield from flush()
        yield from rows(3, [(f, _squeeze((k, 3), (n, 6))) for f, k, n in by_fragment(low[0] % LOW_PARTS, LOW_PARTS, *low)], None)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _squeeze(*cols: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned integers in their low so many bytes, byte by byte of all rows, compressed; its length and number of rows first."""
    planes = [np.ascontiguousarray(a.view(np.uint8) if w == a.itemsize == 1 else np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for a, w in cols]
    got = pa.compress(b"".join(planes), codec="zstd", asbytes=True)
    return len(got).to_bytes(8, "little") + len(cols[0][0]).to_bytes(8, "little") + got


def _expand(raw, *widths: int) -> tuple[list[np.ndarray], object]:
    """The columns at the begin of raw, those of one byte as bytes, and what follows them."""
    size, n = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    got = np.frombuffer(pa.decompress(raw[16 : 16 + size], n * sum(widths), codec="zstd"), np.uint8)
    out, at = [], 0
    for w in widths:
        if w == 1:
            out.append(got[at : at + n])
        else:
            a = np.zeros((n, 8), np.uint8)
            a[:, :w] = got[at : at + n * w].reshape(w, n).T
            out.append(a.view("<i8").ravel())
        at += n * w
    return out, raw[16 + size :]


def _added(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each."""
    k, back = np.unique(k, return_inverse=True)
    return k, np.bincount(back, n, len(k)).astype(np.int64)


def _home(k: np.ndarray, n_frag: int) -> np.ndarray:
    """The fragment of each 6-symbol string: by its last three context symbols."""
    return (mix(((k >> 8) & 0xFFFFFF).view(U)) % U(n_frag)).astype(np.uint16 if n_frag <= 1 << 16 else np.int64)  # short numbers are sorted faster


def _count(table: pa.Table) -> pa.Table:
    """Of one fragment: for each batch of documents how often training texts have its tokens, in their order; under part null the training tokens and distinct ones."""
    got = [_expand(b.as_buffer().to_pybytes(), 8, 4)[0] for b in table.column("blob")]
    words, back = np.unique(np.concatenate([g[0] for g in got]).view(U), return_inverse=True)
    c = np.bincount(back, np.concatenate([g[1] for g in got]), len(words)).astype(np.int64)
    each = c[back]
    ends = np.cumsum([0, *(len(g[0]) for g in got)])
    blobs = [_squeeze((each[a:b], 6)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    frag, part = table.column("frag").to_pylist(), table.column("part").to_pylist()
    blobs.append(np.array([c.sum(), (c > 0).sum()], np.int64).tobytes())
    return pa.table({"kind": pa.array([3] * len(blobs), pa.int32()), "frag": pa.array([*frag, None], pa.int32()), "part": pa.array([*part, None], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _strings(blobs: list[bytes], low: Low) -> Iterator[bytes]:
    """Of one fragment: for each batch of documents the log10 probability of its strings, in their order. A context that all batches have is in one fragment, however many they are; so batches are read one by one, once to add up and once to answer."""
    some, held, k, n = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, b in enumerate(blobs, 1):
        some.append(_expand(b, 6, 4)[0])
        held += len(some[-1][0])
        if held > max(PIECE, len(k)) or i == len(blobs):
            k, n = _added(*(np.concatenate([a, *(x[j] for x in some)]) for j, a in enumerate((k, n))))
            some, held = [], 0
    seen = n > 0
    deep = Deep(low, k[seen], n[seen])
    logs = np.concatenate([np.zeros(0, "<f4"), *(deep.logs(k[a : a + PIECE // 4]).astype("<f4") for a in range(0, len(k), PIECE // 4))])
    del deep
    for b in blobs:
        yield logs[np.searchsorted(k, _expand(b, 6, 4)[0][0])].tobytes()


def _gather(table: pa.Table, n_frag: int, rare: np.ndarray) -> pa.Table:
    """Of one batch of documents: its table with what all fragments know of it, as rows; logs still without the total. rare: log10 share of each byte in its symbol."""
    docs = table.filter(pc.equal(table.column("kind"), 1)).column("blob")[0].as_buffer().to_pybytes()
    (ids, none, held, n_words, lens), rest = _expand(docs, 8, 1, 1, 5, 5)
    data = _expand(rest, 1)[0][0]
    offs = np.concatenate([[0], np.cumsum(lens)])
    counts = [_expand(b, 6)[0][0] for b in table.filter(pc.equal(table.column("kind"), 3)).sort_by("frag").column("blob").to_pylist()]
    h, doc = _words(data, offs)
    each = np.concatenate([np.zeros(0, np.int64), *counts])[np.unique(h, return_inverse=True)[1]]
    known, logs = (np.bincount(doc, x, len(ids)) for x in (each > 0, np.log10(each + 0.5)))
    del h, doc, each
    mine = table.filter(pc.equal(table.column("kind"), 4)).sort_by("frag")
    values = np.frombuffer(b"".join(mine.column("blob").to_pylist()), "<f4")
    score = scores_of(data, offs, lambda k: _placed(k, n_frag, values) + rare[k & 0xFF])
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=none > 0), "held_out": held > 0, "n_words": n_words, "n_known": known.astype(np.int64), "logs": logs, "score": score})


def _placed(k: np.ndarray, n_frag: int, values: np.ndarray) -> np.ndarray:
    """The values of strings in order, from those by fragment."""
    out = np.zeros(len(k))
    out[np.argsort(_home(k, n_frag), kind="stable")] = values
    return out


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and its text; hashed by a few whole texts at once."""
    hashes, docs, lo = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        c = Chunk(None, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        c.words()
        hashes.append(c.word_hashes(True))
        docs.append(c.wdoc + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(docs)


def _pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The 6-symbol strings that end at each byte and at each text's end, as numbers, some at once: the first text, the strings, and the text of each counted from the first. A piece has whole texts, at most 2**16, or a part of a long one."""
    n = len(offs) - 1
    begin = offs + (DEPTH + 1) * np.arange(n + 1)  # of each text with the ends before it and one after
    scored = np.ones(begin[-1], bool)
    scored[begin[1:] - 1] = False
    for j in range(DEPTH):  # the ends before a text are context only
        scored[begin[:-1] + j] = False
    s = np.full(len(scored), STOP, np.uint8)
    s[scored] = data
    scored[begin[1:] - 1] = True
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(begin, begin[lo] + PIECE, "right")) - 1), lo + (1 << 16))
        for a in range(begin[lo] + DEPTH, begin[hi], PIECE if hi == lo + 1 else len(s)):
            b = min(begin[hi], a + PIECE)
            k = s[a:b].astype(np.int64)
            for j in range(1, DEPTH + 1):
                k |= s[a - j : b - j].astype(np.int64) << (8 * j)
            k = k[scored[a:b]]
            yield lo, k, np.repeat(np.arange(hi - lo), offs[lo + 1 : hi + 1] - offs[lo:hi] + 1) if hi > lo + 1 else np.zeros(len(k), np.int64)
        lo = hi


def strings_of(data: np.ndarray, offs: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 6-symbol strings of texts, in order, and how often training texts have each."""
    k, at = np.zeros(len(data) + len(offs) - 1, np.int64), 0
    for lo, keys, doc in _pieces(data, offs):
        k[at : at + len(keys)] = (keys << 1) | train[lo + doc]
        at += len(keys)
    k.sort()  # of a string, those in training texts are last
    first = _starts(k, 1)
    return k[first] >> 1, np.add.reduceat(k.view(np.uint8)[::8] & 1, first, dtype=np.int64)


def scores_of(data: np.ndarray, offs: np.ndarray, value) -> np.ndarray:
    """The sum of value(distinct strings, in order) over each text's 6-symbol strings."""
    k, at, some = np.zeros(len(data) + len(offs) - 1, U), 0, []
    for lo, keys, doc in _pieces(data, offs):
        mine = k[at : at + len(keys)]
        mine[:] = (keys << 16) | doc
        mine.sort()
        first = _starts(mine, 16)
        some.append((lo, mine, first, (mine[first] >> U(16)).view(np.int64)))
        at += len(keys)
    all_ = np.sort(np.concatenate([np.zeros(0, np.int64), *(x[3] for x in some)]))
    all_ = all_[_starts(all_, 0)]
    values, out = value(all_), np.zeros(len(offs) - 1)
    for lo, mine, first, keys in some:
        each = np.repeat(values[np.searchsorted(all_, keys)], np.diff(first, append=len(mine)))
        sums = np.bincount((mine & U(0xFFFF)).view(np.int64), each)
        out[lo : lo + len(sums)] += sums
    return out


def _starts(k: np.ndarray, bits: int) -> np.ndarray:
    """Where, in order, what is above so many bits changes."""
    new = np.ones(len(k), bool)
    for a in range(1, len(k), PIECE):
        b = min(len(k), a + PIECE)
        new[a:b] = (k[a:b] ^ k[a - 1 : b - 1]) >> k.dtype.type(bits) != 0
    return np.flatnonzero(new)


class Slots:
    """Numbers of distinct keys by open addressing; looks up whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        rest = np.arange(len(keys))
        slot = self._slot(keys)
        while len(rest):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[rest[free]]  # of several for one slot, the last stays
            won = self.keys[slot] == keys[rest]
            self.to[slot[won]] = rest[won]
            rest, slot = rest[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return (mix(keys.view(U)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.to[slot], np.int32(-1))
        rest = np.flatnonzero((got != keys) & (got >= 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got, want = self.keys[slot], keys[rest]
            hit = got == want
            out[rest[hit]] = self.to[slot[hit]]
            go = ~hit & (got >= 0)
            rest, slot = rest[go], slot[go]
        return out


class Level:
    """Contexts of one depth below the dense ones, of symbols of so many bits."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, total, suffix, bits: int = 6):
        """cells: context and symbol; n: counts. total(contexts): occurrences, if cells don't have them all. suffix(context per cell, symbols, group): what is left in the context's suffix (see below)."""
        self.bits = bits
        ctx, group = np.unique(cells >> bits, return_inverse=True)
        self.nodes, self.cells = Slots(ctx), Slots(cells)
        seen, kept = np.bincount(group, minlength=len(ctx)), np.bincount(group, n, len(ctx))
        t = np.maximum(total(ctx), kept) if total else kept
        self.t, self.kept, self.seen, self.n = t, kept, seen, n
        den = t + seen
        log = lambda x: np.log10(np.maximum(x, 1e-30)).astype(np.float32)
        self.den, self.escape = log(den), log((t - kept + seen) / np.maximum(den, 1))
        self.value = log(n) - self.den[group] if len(ctx) else np.zeros(0, np.float32)
        den, escape = suffix(ctx, cells, group, seen)
        self.next_den, self.next_escape = log(den), log(escape)

    def after(self, keys, lower, lower_seen, lower_den, lower_escape):
        """log10 probabilities one level deeper, and what the next one needs."""
        node, cell = self.nodes.find(keys >> self.bits), self.cells.find(keys)
        i = np.maximum(node, 0)
        if not len(self.den):
            return lower, lower_seen, lower_den, lower_escape
        left = np.where(lower_seen, lower_den - self.next_den[i], self.next_escape[i] - lower_escape)
        out = np.where(node < 0, lower, np.where(cell >= 0, self.value[np.maximum(cell, 0)], self.escape[i] + lower + left))
        return out, cell >= 0, self.den[i], self.escape[i]


class Model:
    """A trained trie of 64 symbols held whole: dense to depth 3, by tables below. Scoring doesn't use it; a test holds Level and trie by it."""

    def __init__(self, symbol, rare, counts, cells5, n5, cells6, n6, texts):
        self.symbol, self.rare = symbol, rare
        self.seen3 = counts > 0
        dense = counts.reshape(-1, SYMBOLS)
        n, k = dense.sum(1, dtype=np.float64), (dense > 0).sum(1)
        den3, esc3 = n + k * (k < SYMBOLS), np.where(n > 0, k * (k < SYMBOLS) / np.maximum(1, n + k), 1.0)
        self.den3, self.esc3 = (np.log10(np.maximum(x, 1e-30)).astype(np.float32) for x in (den3, esc3))

        def total(find, n):
            def of(ctx):  # a context that ends in an end stands at the begin of every text
                at = find(ctx)
                return np.where((ctx & 63) == END, texts, np.where(at >= 0, n[np.maximum(at, 0)] if len(n) else 0, 0)).astype(np.float64)

            return of

        def above3(ctx, cells, group, seen):
            low = ctx & 0x3FFFF
            gone = np.bincount(group, counts[cells & 0xFFFFFF], len(ctx))
            left, more = n[low] - gone, (k[low] - seen) * (k[low] < SYMBOLS)
            d = left + more
            return d, np.where(left > 0.5, more / np.maximum(1, d), 1.0)

        self.level4 = Level(cells5, n5, total(lambda c: c, counts), above3)
        four = self.level4

        def above4(ctx, cells, group, seen):
            node, cell = four.nodes.find(ctx & 0xFFFFFF), four.cells.find(cells & 0x3FFFFFFF)
            gone = np.bincount(group, four.n[cell] if len(cell) else None, len(ctx))
            left, kept, more = four.t[node] - gone, four.kept[node] - gone, four.seen[node] - seen
            d = left + more
            return d, np.where(d > 0.5, (left - kept + more) / np.maximum(1, d), 1.0)

        self.level5 = Level(cells6, n6, total(four.cells.find, four.n), above4)
        for level in (self.level4, self.level5):
            level.t = level.kept = level.seen = level.n = None
        self.table = trie(counts)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each 6-symbol string after the others."""
        k4 = keys & 0xFFFFFF
        out = self.table[k4], self.seen3[k4], self.den3[k4 >> 6], self.esc3[k4 >> 6]
        out = self.level4.after(keys & 0x3FFFFFFF, *out)
        return self.level5.after(keys, *out)[0]


def trie(counts: np.ndarray, s: int = SYMBOLS, depth: int = 3) -> np.ndarray:
    """log10 probabilities, (context of ``depth``) x symbol, from the counts of strings of one symbol more."""
    levels = [counts.reshape(-1, s)]
    for _ in range(depth):
        c = levels[-1]
        levels.append(c.reshape(s, -1, s).sum(0))
    # From the empty context up: the probability of each symbol, those that the longer context has seen excluded.
    lower = None
    for c in reversed(levels):
        out = np.empty(c.shape, np.float64 if len(c) < s**depth else np.float32)
        for lo in range(0, len(c), s * s):
            rows = c[lo : lo + s * s].astype(np.float64)
            seen = rows > 0
            n, k = rows.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            if lower is None:
                below = np.where(seen, 0, 1.0)
                below /= np.maximum(1, below.sum(1, keepdims=True))
            else:
                below = lower(seen, np.arange(lo, lo + len(rows)) % (len(c) // s or 1))
            escape = np.where(n > 0, k / np.maximum(1, n + k), 1.0) * (k < s)  # nothing to escape to if all are seen
            out[lo : lo + len(rows)] = np.where(seen, rows / np.maximum(1, n + k * (k < s)), escape * below)

        def lower(excluded, at, c=c, lower=lower):
            """Probabilities at these rows of c when some symbols can't come."""
            rows = np.where(excluded, 0, c[at]).astype(np.float64)
            seen = rows > 0
            n, k = rows.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            all_ = (c[at] > 0) | excluded
            left = s - all_.sum(1, keepdims=True)
            if lower is None:
                below = np.where(all_, 0, 1.0) / np.maximum(1, left)
            else:
                below = lower(all_, at % (len(c) // s or 1))
            escape = np.where(n > 0, k / np.maximum(1, n + k), 1.0) * (left > 0)
            return np.where(seen, rows / np.maximum(1, n + k * (left > 0)), escape * below)

    np.log10(np.maximum(out, 1e-30), out=out)
    return out.ravel()


class Low:
    """The trie to depth 2, over the bytes that training has, the end, and one symbol for all other bytes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        """keys: 3-symbol strings; n: their counts."""
        seen = np.unique(np.append(keys & 0xFF, STOP))
        self.size = s = len(seen) + 1
        self.symbol = np.full(256, s - 1, np.int64)
        self.symbol[seen] = np.arange(s - 1)
        self.rare = np.zeros(256)
        others = np.setdiff1d(np.unique(np.append(_FOLD, STOP)), seen)
        self.rare[others] = -math.log10(max(1, len(others)))
        at = self.cell(keys)
        order = np.argsort(at)
        self.at, self.n = at[order], n[order].astype(np.float64)
        counts = np.zeros(s**3)
        counts[at] = n
        dense = counts.reshape(-1, s)
        self.total, self.kinds = dense.sum(1), (dense > 0).sum(1)
        more = self.kinds * (self.kinds < s)
        self.den = np.log10(np.maximum(self.total + more, 1e-30)).astype(np.float32)
        self.escape = np.log10(np.maximum(np.where(self.total > 0, more / np.maximum(1, self.total + more), 1.0), 1e-30)).astype(np.float32)
        self.table = trie(counts, s, 2)

    def cell(self, keys: np.ndarray) -> np.ndarray:
        """The cell of each string's last three symbols."""
        a, b, c = (self.symbol[(keys >> j) & 0xFF] for j in (16, 8, 0))
        return (a * self.size + b) * self.size + c

    def counts(self, cells: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.zeros(len(cells))
        i = np.minimum(np.searchsorted(self.at, cells), len(self.at) - 1)
        return np.where(self.at[i] == cells, self.n[i], 0.0)


class Deep:
    """The trie of one fragment: Low, and below it all contexts of depth 3 to 5 whose last three symbols the fragment has."""

    def __init__(self, low: Low, keys: np.ndarray, n: np.ndarray):
        """keys: 6-symbol strings of the training texts; n: their counts."""
        self.low = low

        def above(ctx, cells, group, seen):
            at = low.cell(cells)
            i = np.zeros(len(ctx), np.int64)
            i[group] = at // low.size
            left = low.total[i] - np.bincount(group, low.counts(at), len(ctx))
            more = (low.kinds[i] - seen) * (low.kinds[i] < low.size)
            return left + more, np.where(left > 0.5, more / np.maximum(1, left + more), 1.0)

        self.levels = []
        for depth in (3, 4, 5):
            level = Level(*_added(keys & ((1 << (8 * depth + 8)) - 1), n), None, above, 8)

            def above(ctx, cells, group, seen, up=level, depth=depth):
                node, cell = up.nodes.find(ctx & ((1 << (8 * depth)) - 1)), up.cells.find(cells & ((1 << (8 * depth + 8)) - 1))
                left = up.t[node] - np.bincount(group, up.n[cell] if len(cell) else None, len(ctx))
                more = up.seen[node] - seen
                return left + more, np.where(left > 0.5, more / np.maximum(1, left + more), 1.0)

            self.levels.append(level)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each 6-symbol string after the others."""
        at = self.low.cell(keys)
        ctx = at // self.low.size
        out = self.low.table[at], self.low.counts(at) > 0, self.low.den[ctx], self.low.escape[ctx]
        for depth, level in zip((3, 4, 5), self.levels, strict=True):
            out = level.after(keys & ((1 << (8 * depth + 8)) - 1), *out)
        return out[0]


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Trained on rows whose crc32(doc_id as text) mod 5 is not 1; a null doc_id is
    the empty text there. base_score: unigram log10 probability of words (A-Z
    folded) and one end. score: log10 probability of the folded text's bytes and
    its end by the trained trie, of which nothing is left out. Null texts count as empty: one token, the end.
    Very long texts are scored whole; repeated rows alike, each counting in
    training. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % 5) == 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~held).alias("train"))
    trained, size = docs.agg(F.count_if("train"), F.sum(F.octet_length("text"))).first()
    n_frag = fragments(spark, size or 0)
    cut = written(_postings(docs, n_frag))

    def add(table):
        got = [_expand(b.as_buffer().to_pybytes(), 3, 6)[0] for b in table.column("blob")]
        return pa.table({"blob": pa.array([_squeeze(*zip(_added(*(np.concatenate([g[i] for g in got]) for i in (0, 1))), (3, 6), strict=True))], pa.binary())})

    short = [_expand(bytes(r.blob), 3, 6)[0] for r in cut.where("kind = 3").select("frag", "blob").groupBy("frag").applyInArrow(add, "blob binary").toLocalIterator()]
    low = Low(*(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in short)]) for i in (0, 1)))
    shared, rare = spark.sparkContext.broadcast(low), low.rare
    sums = settle(cut.where("kind = 0").select("frag", "part", "blob").groupBy("frag").applyInArrow(_count, "kind int, frag int, part long, blob binary"))

    def total(batches):
        for b in batches:
            n = sum((np.frombuffer(x.as_buffer(), np.int64) for x in b.column(0)), np.zeros(2, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in n], ["n", "v"])

    words, distinct = sums.where("part is null").select("blob").mapInArrow(total, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = (words or 0) + trained, (distinct or 0) + (trained > 0)

    answers = arrow_schema("kind int, frag int, part long, blob binary")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out, size = [r for b in batches for r in b.to_pylist()], [], 0
        for i, blob in enumerate(_strings([r["blob"] for r in rows], shared.value), 1):
            out.append(blob)
            size += len(blob)
            if size > PIECE or i == len(rows):
                some = rows[i - len(out) : i]
                yield record({"kind": [4] * len(out), "frag": [r["frag"] for r in some], "part": [r["part"] for r in some], "blob": out}, answers)
                out, size = [], 0

    logs = cut.where("kind = 2").select("frag", "part", "blob").groupBy("frag").applyInArrow(answer, "kind int, frag int, part long, blob binary")
    both = cut.where("kind = 1").select("kind", "frag", "part", "blob").union(sums.where("part is not null")).union(logs)
    got = both.groupBy("part").applyInArrow(lambda t: _gather(t, n_frag, rare), "doc_id long, held_out boolean, n_words long, n_known long, logs double, score double")
    got = got.withColumn("n_tokens", F.col("n_words") + 1).withColumn("n_known", F.col("n_known") + int(trained > 0))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") + math.log10(trained + 0.5) - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"), "score")
