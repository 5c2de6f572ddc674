"""Substring dedup: words covered by a window of 50 that also starts in an earlier document.

1. ``anchors``: of the 16-word phrases in each window the least one is its
   anchor. Equal windows have equal anchors, wherever they stand, so a phrase
   that is an anchor in one document only belongs to no recurring passage. The
   order is by hash, but phrases that are anchors in very many documents come
   last, so that a common line doesn't stand for all the windows around it.
2. ``_cut``: each batch of documents names the phrases that may recur, and cuts
   out the pieces of text whose windows they stand for, each different piece
   once, with the least doc_id that has it. A phrase is confirmed when its words
   are anchors in two documents or more.
3. ``_locate``: phrases and pieces are dealt to shards by the phrase. A shard
   compiles an Aho-Corasick automaton of its confirmed phrases and streams every
   piece through it. Each occurrence it locates gives the windows around it;
   windows are compared word for word, and the shard answers each batch with the
   least doc_id that has each window.
4. ``_gather``: a batch turns the answers into flagged windows of its rows, and
   only documents with a flag are joined with them; others are written as they
   are.

Hashes only choose anchors, filter and route; what recurs is decided by words.
What is broadcast has a fixed size: a bitmap of phrases that may recur (a filter
without false negatives; full, it lets all pieces through), at most MAX_HOT hot
phrases, which set the order only, and a bitmap of rows with a flag.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import accumulate, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, Chunk, arrow_schema, bitmap, bitmap_table, bound_batches, each_chunk, fragment_of, id_column, maybe_in, mix, pack, partitions, probe, record, settle, signed, unpack, written

WINDOW, PHRASE, BITS = 50, 16, 26
#: A batch ends after so many candidate windows.
FLUSH = 1 << 20
#: Phrases that are anchors in so many documents come last in the order; so many of them at most.
HOT, MAX_HOT = 1024, 1 << 16
#: About so many pieces go to a shard.
SHARD_PIECES = 1 << 14
_NONE = U((1 << 64) - 1)
_NOBODY = (1 << 63) - 1


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling; runs past the end take what is there."""
    out, done = g.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:].copy())
        done += step
    return out


class Hot:
    """The phrases that come last in the order of anchors."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> U(43)).astype(np.int64)] = True

    def order(self, h: np.ndarray) -> np.ndarray:
        """The place of each phrase in the order: its hash in 63 bits, above these one for hot ones."""
        h = h >> U(1)
        if not len(self.keys):
            return h
        near = np.flatnonzero(self.bits[(h >> U(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        hot = near[self.keys[at] == h[near]]
        h[hot] |= U(1 << 63)
        return h


def _phrases(c: Chunk, window: int, phrase: int, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """The phrase at each word by its place in the order (the largest value where none starts), and the words at which a window starts."""
    c.words()
    wh = c.word_hashes()
    h, at = c.shingles(wh, phrase)
    g = np.full(len(wh), _NONE, U)
    g[at] = hot.order(h)
    starts = np.flatnonzero(np.arange(len(wh)) + window <= c.woff[1:][c.wdoc]) if len(wh) else np.zeros(0, np.int64)
    return g, starts


def anchors(docs: DataFrame, window: int, phrase: int, hot: Hot | None = None) -> DataFrame:
    """(h, n): anchors by their place in the order, and in how many documents; a task sums before it sends."""
    out = arrow_schema("h long, n long")
    shared = docs.sparkSession.sparkContext.broadcast(hot or Hot(np.zeros(0, U)))

    def run(batches):
        parts, held = [], 0

        def flush():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return record({"h": signed(h), "n": n}, out)

        for c in each_chunk(batches):
            g, starts = _phrases(c, window, phrase, shared.value)
            if not len(starts):
                continue
            a, doc = _least(g, window - phrase + 1)[starts], c.wdoc[starts]
            change = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
            a, doc = a[change], doc[change]
            order = np.lexsort((a, doc))
            a, doc = a[order], doc[order]
            parts.append(a[np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])])
            held += len(parts[-1])
            if held > FLUSH // 2:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()

    bound_batches(docs.sparkSession)
    return docs.where("doc_id is not null").select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _plain(c: Chunk) -> tuple[bytes, np.ndarray]:
    """The chunk's words, each followed by one space, and where each begins."""
    lens = c.we - c.ws
    inside = np.zeros(len(c.data) + 1, np.int8)
    inside[c.ws] = 1
    inside[c.we] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    word = np.repeat(np.arange(len(lens)), lens)
    out = np.full(len(word) + len(lens), 0x20, np.uint8)
    out[np.arange(len(word)) + word] = c.data[inside]
    return out.tobytes(), np.concatenate([[0], np.cumsum(lens + 1)])


def _joined(pieces: list[bytes], ids: list[int]) -> bytes:
    """Pieces, each with the least doc_id that has it, compressed."""
    raw = b"".join(pieces)
    head = len(pieces).to_bytes(8, "little") + len(raw).to_bytes(8, "little")
    return head + pa.compress(pack((np.array(ids, np.int64).view(U), 8), (np.array([len(x) for x in pieces], U), 4)) + raw, codec="zstd", asbytes=True)


def _pieces(blob) -> tuple[list[bytes], np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    raw = pa.decompress(blob[16:], 12 * n + size, codec="zstd", asbytes=True)
    ids, lens = np.frombuffer(raw, np.uint8, 8 * n).view("<i8"), unpack(raw[8 * n : 12 * n], 4)[0].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lens)]) + 12 * n
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], ids


def _cut(docs: DataFrame, bits: np.ndarray, hot: Hot, window: int, phrase: int, n_shards: int) -> DataFrame:
    """By batch of documents. kind 0: a phrase that may recur, for its shard, with the number of documents; kind 1: the different pieces for a shard; kind 2: rows of the batch and where each piece stands in them."""
    schema = "kind int, shard int, part long, phrase binary, n long, blob binary"
    out = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast((bits, hot))

    def rows(m, kind, **cols):
        return record({f.name: cols[f.name] if f.name in cols else np.full(m, kind, np.int32) if f.name == "kind" else pa.nulls(m, f.type) for f in out}, out)

    def run(batches):
        bits, hot = shared.value
        part = TaskContext.get().partitionId() << 24
        found: list[tuple] = []  # of each chunk: (row, first word, windows, shard), then its pieces
        owners: list[tuple] = []
        known: dict[bytes, int] = {}  # phrase: documents
        held, n_rows = 0, 0

        def flush():
            row, first, n, shard = (np.concatenate([f[i] for f in found]) for i in range(4))
            texts = [t for f in found for t in f[4]]
            ids, keys = (np.concatenate([o[i] for o in owners]) for i in range(2))
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
            least = np.full(len(number), _NOBODY, np.int64)
            np.minimum.at(least, which, ids[row])
            home, count = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            home[which], count[which] = shard, n
            order = np.argsort(home, kind="stable")  # pieces are numbered by shard
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            distinct = list(number)
            ends = np.searchsorted(home[order], np.arange(n_shards + 1))
            for s in np.flatnonzero(np.diff(ends)):
                own = order[ends[s] : ends[s + 1]]
                yield rows(1, 1, shard=[int(s)], part=[part], blob=[_joined([distinct[i] for i in own], least[own].tolist())])
            own, row = np.unique(row, return_inverse=True)
            head = len(own).to_bytes(8, "little") + len(order).to_bytes(8, "little")
            body = pack((ids[own].view(U), 8), (keys[own].view(U), 8)) + pack((count[order].view(U), 4)) + pack((row.view(U), 4), (first.view(U), 4), (place[which].view(U), 4))
            yield rows(1, 2, part=[part], blob=[head + len(row).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)])
            some = list(known)
            for i in range(0, len(some), 4096):
                p = some[i : i + 4096]
                shard = fragment_of(mix(np.array([hashed[x] for x in p], U)), n_shards).astype(np.int32)
                yield rows(len(p), 0, shard=shard, phrase=p, n=[known[x] for x in p])

        hashed: dict[bytes, int] = {}
        for c in each_chunk(batches):
            g, starts = _phrases(c, window, phrase, hot)
            if not len(starts):
                continue
            a = _least(g, window - phrase + 1)[starts]
            maybe = probe(bits, mix(a))
            starts, a = starts[maybe], a[maybe]
            if not len(starts):
                continue
            # A piece: windows that follow each other under one anchor.
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (np.diff(starts) != 1) | (c.wdoc[starts[1:]] != c.wdoc[starts[:-1]])]))
            n = np.diff(np.append(head, len(starts)))
            first, a = starts[head], a[head]
            raw, at = _plain(c)
            texts = [raw[x:y] for x, y in zip(at[first].tolist(), at[first + n - 1 + window].tolist(), strict=True)]
            doc = c.wdoc[first]
            by = np.lexsort((doc, a))
            own = np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (doc[by][1:] != doc[by][:-1])])
            keys, times = np.unique(a[by][own], return_counts=True)
            order = np.argsort(g, kind="stable")
            where = order[np.searchsorted(g[order], keys)]
            for k, t, x, y in zip(keys.tolist(), times.tolist(), at[where].tolist(), at[where + phrase].tolist(), strict=True):
                p = raw[x:y]
                known[p] = known.get(p, 0) + t
                hashed[p] = k
            found.append((doc + n_rows, first - c.woff[doc], n, fragment_of(mix(a), n_shards).astype(np.int64), texts))
            owners.append((np.asarray(id_column(c)), np.asarray(c.rows.column(c.rows.schema.get_field_index("row_key")))))
            held, n_rows = held + len(starts), n_rows + c.n
            if held > FLUSH:
                yield from flush()
                part, held, n_rows = part + 1, 0, 0
                found, owners, known, hashed = [], [], {}, {}
        if held:
            yield from flush()

    bound_batches(docs.sparkSession)
    return docs.where("doc_id is not null").select("doc_id", "row_key", "text").mapInArrow(run, schema)


def compiled(phrases: list[bytes]) -> tuple[ahocorasick.Automaton | None, dict[bytes, int]]:
    """The automaton of the phrases over numbers of their words, and these numbers."""
    ids: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, p in enumerate(phrases):
        automaton.add_word(tuple([ids.setdefault(w, len(ids) + 1) for w in p.split()]), i)
    if phrases:
        automaton.make_automaton()
    return automaton if phrases else None, ids


def _locate(window: int, phrase: int):
    def run(phrases: pa.Table, sent: pa.Table) -> pa.Table:
        """Of one shard: for each batch the least doc_id that has each window of its pieces, in order; the largest number where no confirmed phrase occurs."""
        automaton, ids = compiled(phrases.column("phrase").to_pylist())
        got = [_pieces(b.as_buffer().to_pybytes()) for b in sent.column("blob")]
        texts, owner = [t for g in got for t in g[0]], np.concatenate([np.zeros(0, np.int64), *(g[1] for g in got)]).tolist()
        hits: dict[int, list] = {}
        answer, starts = [], []
        number = ids.get
        for i, t in enumerate(texts):
            words = t.split()
            answer.append(np.full(len(words) - window + 1, _NOBODY, np.int64))
            if automaton is None:
                continue
            for end, k in automaton.iter(tuple([number(w, 0) for w in words])):
                hits.setdefault(k, []).append((i, end - phrase + 1))
        for found in hits.values():
            if len(found) == 1:  # one piece, whoever has it
                (i, p), = found
                lo, hi = max(0, p + phrase - window), min(len(answer[i]), p + 1)
                answer[i][lo:hi] = owner[i]
                continue
            # Without the spaces, of which each word has one.
            begins = {i: array("I", accumulate(map(len, texts[i].split()), initial=0)) for i in {i for i, _ in found}}
            # Equal windows have the phrase at the same word: those of one place at a time are held, not those of all.
            for place in range(window - phrase + 1):
                best: dict[bytes, int] = {}
                spans = []
                for i, p in found:
                    s = p - place
                    if 0 <= s < len(answer[i]):
                        t, at, d = texts[i], begins[i], owner[i]
                        k = t[at[s] + s : at[s + window] + s + window]
                        first = best.setdefault(k, d)
                        if d < first:
                            best[k] = d
                        spans.append((i, s, k))
                for i, s, k in spans:
                    if best[k] < answer[i][s]:
                        answer[i][s] = best[k]
        blobs, done = [], 0
        for g in got:
            mine = np.concatenate(answer[done : done + len(g[0])])
            blobs.append(len(mine).to_bytes(8, "little") + pa.compress(mine.tobytes(), codec="zstd", asbytes=True))
            done += len(g[0])
        return pa.table({"kind": pa.array([3] * len(got), pa.int32()), "shard": sent.column("shard").combine_chunks(), "part": sent.column("part").combine_chunks(), "blob": pa.array(blobs, pa.binary())})

    return run


def _gather(table: pa.Table) -> pa.Table:
    """Of one batch: the flagged windows of each of its rows, in order."""
    raw = table.filter(pc.equal(table.column("kind"), 2)).column("blob")[0].as_buffer().to_pybytes()
    n, m, k = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8, 16))
    raw = pa.decompress(raw[24:], 16 * n + 4 * m + 12 * k, codec="zstd", asbytes=True)
    ids, keys = (np.frombuffer(raw, "<i8", n, 8 * n * i) for i in (0, 1))
    count, row, first, place = (np.frombuffer(raw, "<u4", size, at).astype(np.int64) for size, at in ((m, 16 * n), (k, 16 * n + 4 * m), (k, 16 * n + 4 * m + 4 * k), (k, 16 * n + 4 * m + 8 * k)))
    told = table.filter(pc.equal(table.column("kind"), 3)).sort_by("shard").column("blob").to_pylist()
    least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(pa.decompress(b[8:], 8 * int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), "<i8") for b in told)])
    begin, size = np.cumsum(count) - count, count[place]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    late = least[np.repeat(begin[place], size) + step] < np.repeat(ids[row], size)
    row, pos = np.repeat(row, size)[late], (np.repeat(first, size) + step)[late]
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order].astype(np.uint32)
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(head, len(row))
    return pa.table({"row_key": pa.array(keys[row[head]], pa.int64()), "at": pa.array([pos[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _rest(raw: bytes, at: bytes | None, window: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    words = raw.split()  # of bytes: exactly the six separators
    if not at:
        return len(words), 0, b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    pos = np.frombuffer(at, np.uint32)
    step[pos] += 1
    np.subtract.at(step, pos.astype(np.int64) + window, 1)
    keep = np.cumsum(step[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join(compress(words, keep.tolist()))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, texts: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text), and kept_text if ``texts``.

    Words are taken unchanged; each one covered by a window of ``window`` words
    whose sequence also starts in a document with a smaller doc_id is removed.
    Windows are those of the input. Null and empty texts have no words, and the
    hash of the empty string. Rows with a null doc_id neither lose words nor
    make others lose any. Rows that repeat with the same doc_id and text get the
    same result; texts of one doc_id don't count as earlier for each other. Very
    long texts are read whole. An empty table gives an empty one; other columns
    are ignored. ``hot``: phrases that are anchors in so many documents come
    last in the order of anchors, which changes the work and not the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    shared = settle(anchors(docs, window, phrase).where("n > 1"))
    keys = shared.where(F.col("n") >= hot).orderBy(F.desc("n"), "h").limit(MAX_HOT).select("h").toPandas()["h"].to_numpy(np.int64).view(U)
    last = Hot(keys)
    if len(keys):
        shared = settle(anchors(docs, window, phrase, last).where("n > 1"))
    n_shards = max(partitions(spark), -(-(shared.agg(F.sum("n")).first()[0] or 0) // SHARD_PIECES))

    def mixed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(mix(np.asarray(b.column(0)).view(U))))], ["h"])

    bits = bitmap(shared.select("h").mapInArrow(mixed, "h long"), "h", BITS)
    cut = written(_cut(docs, bits, last, window, phrase, n_shards))
    confirmed = cut.where("kind = 0").groupBy("shard", "phrase").agg(F.sum("n").alias("n")).where("n > 1").select("shard", "phrase")
    pieces = cut.where("kind = 1").select("shard", "part", "blob")
    told = confirmed.groupBy("shard").cogroup(pieces.groupBy("shard")).applyInArrow(_locate(window, phrase), "kind int, shard int, part long, blob binary")
    both = cut.where("kind = 2").select("kind", "shard", "part", "blob").union(told)
    late = settle(both.groupBy("part").applyInArrow(_gather, "row_key long, at binary").dropDuplicates(["row_key"]))
    key = F.xxhash64("row_key")
    rows = maybe_in(docs.withColumn("k", key), "k", bitmap_table(late.select(key.alias("k")), "k", BITS), BITS, "maybe")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    out = arrow_schema(schema)

    def finish(batches):
        for c in each_chunk(batches):
            at = c.rows.schema.get_field_index("at")
            raw, cuts = c.data.tobytes(), c.rows.column(at).to_pylist() if at >= 0 else [None] * c.n
            got = [_rest(raw[a:b], cut, window) for a, b, cut in zip(c.offs[:-1], c.offs[1:], cuts, strict=True)]
            cols = {"doc_id": id_column(c), "n_words": [g[0] for g in got], "n_removed": [g[1] for g in got], "kept_sha256": [hashlib.sha256(g[2]).hexdigest() for g in got]}
            yield record(cols | ({"kept_text": [g[2].decode() for g in got]} if texts else {}), out)

    some = rows.where("maybe").join(late, "row_key", "left").select("doc_id", "text", "at")
    return rows.where("not maybe").select("doc_id", "text").mapInArrow(finish, schema).union(some.mapInArrow(finish, schema))
