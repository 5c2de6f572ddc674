"""Manifest life, dumps, logs, checkpoints, queues and caches against hand-made cases and plain loops."""

import hashlib
import heapq
import math
import random
import time
from collections import Counter, OrderedDict, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_core import SF, slow_cuts

from blockweave.functions import hashing as H
from blockweave.functions import scalars as S
from blockweave.operators import chunking as C
from blockweave.operators import dump as P
from blockweave.operators import manifest as M
from blockweave.operators import ranges as R
from blockweave.operators import resume as Q
from blockweave.operators import state as T
from blockweave.plans import devices  # noqa: F401
from blockweave.plans.catalog import QUERIES
from blockweave.sources import records as X
from blockweave.streaming import replay as Z


# -- content-defined chunks --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def cut(spark):
    out = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        data, at = r.text.encode(), 0
        for i, end in enumerate(slow_cuts(data, 256, 1024, 4096)):
            out.append((r.doc_id, i, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
            at = end
    return out


def test_cdc_queries_cut_as_byte_by_byte(spark, cut):
    assert Counter(tuple(r) for r in QUERIES["cdc_chunks"](spark, SF).select("volume_id", "seq", "offset", "length", "digest").collect()) == Counter(cut)
    sizes = [c[3] for c in cut]
    r = QUERIES["cdc_size_dist"](spark, SF).first()
    assert (r.n_chunks, r.n_below, r.n_above) == (len(sizes), sum(x < 1024 for x in sizes), sum(x > 1024 for x in sizes))
    assert np.isclose(r.mean_length, np.mean(sizes)) and np.isclose(r.median_length, np.median(sizes))
    first = {}
    for v, _, o, _, d in cut:
        first[d] = min(first.get(d, (v, o)), (v, o))
    want = Counter((v, o, n, *first[d]) for v, _, o, n, d in cut if first[d] < (v, o))
    assert Counter(tuple(r) for r in QUERIES["cdc_dedup_refs"](spark, SF).select("volume_id", "offset", "length", "ref_volume", "ref_offset").collect()) == want and want


@pytest.mark.parametrize("volume", [1, 2**41, 2**62, -5])
def test_hybrid_chunks_of_any_volume_id(spark, volume):
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(5000))
    got = C.hybrid_chunks(spark.createDataFrame([(volume, bytearray(data))], "volume_id long, data binary"), 2048, 64, 128, 256).orderBy("block", "seq").collect()
    want = []
    for b in range(0, 5000, 2048):
        at = 0
        for i, end in enumerate(slow_cuts(data[b : b + 2048], 64, 128, 256)):
            want.append((volume, b // 2048, i, b + at, end - at))
            at = end
    assert [tuple(x)[:5] for x in got] == want
    assert b"".join(bytes(x.data) for x in got) == data


def test_blocks_of_parts(spark):
    parts = spark.createDataFrame([(1, 0, bytearray(b"abcd")), (1, 4 << 40, bytearray(b"efghi"))], "volume_id long, start long, data binary")
    got = [(r.seq, r.offset, bytes(r.data)) for r in C.blocks_of_parts(parts, 2).orderBy("seq").collect()]
    assert got == [(0, 0, b"ab"), (1, 2, b"cd"), (2 << 40, 4 << 40, b"ef"), ((2 << 40) + 1, (4 << 40) + 2, b"gh"), ((2 << 40) + 2, (4 << 40) + 4, b"i")]
    with pytest.raises(Exception, match="begin where a block does"):
        C.blocks_of_parts(spark.createDataFrame([(1, 3, bytearray(b"a"))], "volume_id long, start long, data binary"), 2).collect()


# -- hashes and codecs -------------------------------------------------------------------------------
def test_known_hashes(spark):
    rows = spark.createDataFrame([(0, bytearray()), (1, bytearray(b"a")), (2, bytearray(b"123456789"))], "k int, data binary")
    got = {r.k: r.x for r in rows.select("k", H.xxh3_64("data").alias("x")).collect()}
    assert got[0] == "2d06800538d394c2" and got[1] == "e6c632b61e964e1f"
    weak = {r.k: r.w for r in rows.select("k", H.weak_checksum("data").alias("w")).collect()}
    assert weak[1] == 97 + (97 << 16)


def test_queries_of_hashes_and_ratios(spark):
    import xxhash

    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["xxh3"](spark, SF).collect():
        assert r.xxh3 == xxhash.xxh3_64_hexdigest(docs[r.volume_id][r.seq * 1024 : r.seq * 1024 + 1024])
    z = zstandard.ZstdCompressor(level=1)
    for r in QUERIES["compress_decision"](spark, SF).collect():
        x = docs[r.volume_id][r.seq * 8192 : r.seq * 8192 + 8192]
        assert r.ratio == len(z.compress(x)) / len(x) and r.codec == ("none" if r.ratio >= 0.9 else "zstd")


def test_chunks_are_packed_only_where_they_shrink(spark):
    noise = bytearray(random.Random(2).randbytes(9000))
    rows = spark.createDataFrame([(0, noise), (1, bytearray(20000)), (2, bytearray()), (3, None)], "k int, data binary")
    got = {r.k: r for r in T.expand_chunks(T.compress_chunks(rows)).collect()}
    assert {k: r.algorithm for k, r in got.items()} == {0: "none", 1: "zstd", 2: "none", 3: "none"}
    assert all(r.restored == r.data for r in got.values()) and len(got[1].packed) < 100


def test_zero_blocks(spark):
    rows = spark.createDataFrame([(0, bytearray(5)), (1, bytearray(b"\0\0a\0")), (2, bytearray()), (3, bytearray(b"\0" * 9 + b" "))], "k int, data binary")
    assert {r.k: r.z for r in rows.select("k", C.is_zero(F.col("data")).alias("z")).collect()} == {0: True, 1: False, 2: True, 3: False}


# -- scalars -----------------------------------------------------------------------------------------
def test_sizes_are_exact(spark):
    cases = {"1K": 1000, "2 m b": 2 * 10**6, "1E": 10**18, "1EiB": 2**60, "1.0000000001GB": None, "0.1000KB": 100, ".5KiB": 512, "5.": 5, "18.446744073709551615E": 2**64 - 1, "18446744073709551616": None, "0.00000095367431640625EiB": 2**40, "1.2.3K": None, "1 GiBs": None, "0.3KiB": None, "00000000000000000000001": 1}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", S.parse_size_unsigned(F.col("s")).alias("n")).collect()
    assert {r.s: None if r.n is None else int(r.n) for r in got} == cases
    percents = {"50%": 50, "50.0%": 50, " 7 %": 7, "1.5%": None, "-1%": None, "5": None}
    got = spark.createDataFrame([(k,) for k in percents], "s string").select("s", S.parse_percent(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == percents


def test_partition_lines_in_any_order(spark):
    lines = ["/dev/sda1 : start= 2048, size=  100, type=83", "/dev/sda2 : type=82, size=10, start=5, bootable", "# no", "/dev/sda3 : size=10, type=83", ""]
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, s string").orderBy("i").select(S.partition_line(F.col("s")).alias("p")).collect()]
    assert [None if p is None else tuple(p) for p in got] == [(2048, 2147, "83"), (5, 14, "82"), None, None, None]


# -- ranges and order --------------------------------------------------------------------------------
def test_sync_counts_anew(spark):
    rows = spark.createDataFrame([(1, i, 3000) for i in range(6)] + [(2, 0, 9000), (2, 1, 1)], "v long, seq long, length int")
    got = {(r.v, r.seq): r.sync for r in R.sync_groups(rows, ["v"], "seq", 4096).collect()}
    assert [got[1, i] for i in range(6)] == [0, 0, 1, 1, 2, 2] and (got[2, 0], got[2, 1]) == (0, 1)
    saved = {(r.v, r.seq) for r in Q.checkpoints(rows, ["v"], "seq", 4096).collect()}
    assert saved == {(1, 1), (1, 3), (1, 5), (2, 0)}


def test_total_is_held(spark):
    big = 2**63 - 1
    rows = spark.createDataFrame([(1, 0, big), (1, 0, big), (1, 9, 3), (2, 5, 9)], "k long, start long, end long")
    assert {r.k: r.total for r in R.total_bytes(rows, ["k"]).collect()} == {1: big, 2: 4}


def test_change_table_overflows_and_tears(spark):
    word = lambda *x: b"".join(v.to_bytes(8, "little") for v in x)
    data = bytes(1000) + word(2, 1) + word(2**64 - 1, 1) + word((2**64 - 1) // 1000, 3) + word(4, 2) + word(7, 0) + word(9, 9) + b"torn"
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(10)), (3, bytearray(bytes(1000) + word(5, 5)))], "log_id long, data binary")
    got = {(r.log_id, r.pos): (r.start and int(r.start), r.end and int(r.end), r.problem) for r in X.change_records(rows, 1000).collect()}
    assert got == {(1, 0): (2000, 3000, None), (1, 1): (None, None, "start"), (1, 2): (None, None, "end"), (1, 3): (4000, 5000, None), (3, 0): (5000, 6000, None)}
    with pytest.raises(ValueError):
        X.change_records(rows, 0)
    head = lambda *x: bytearray(b"".join(v.to_bytes(4, "little") for v in x))
    heads = spark.createDataFrame([(0, head(0x70416E53, 1, 1, 8)), (1, head(1, 1, 1, 8)), (2, head(0x70416E53, 0, 1, 8)), (3, head(0x70416E53, 1, 2, 8)), (4, bytearray(3))], "k int, data binary")
    got = {r.k: (r.h.chunk_size, r.h.problem) for r in heads.select("k", X.change_header(F.col("data")).alias("h")).collect()}
    assert got == {0: (4096, None), 1: (None, "magic"), 2: (None, "valid"), 3: (None, "version"), 4: (None, "short")}


def test_holes_and_exact_reads(spark):
    blocks = spark.createDataFrame([(1, 0, 10), (1, 10, 10), (1, 20, 10), (2, 0, 10)], "volume_id long, offset long, length int")
    data = spark.createDataFrame([(1, 10, 11), (1, 35, 40), (1, 29, 29)], "volume_id long, start long, end long")
    assert {(r.volume_id, r.offset): r.hole for r in C.holes(blocks, data, 16).collect()} == {(1, 0): True, (1, 10): False, (1, 20): True, (2, 0): True}


# -- dumps -------------------------------------------------------------------------------------------
def volumes(seed=4):
    r = random.Random(seed)
    pool = [bytes([i]) * 16 for i in range(6)] + [bytes(16)] * 2
    old = {v: [r.choice(pool) for _ in range(12)] for v in range(8)}
    new = {v: [x if r.random() < 0.4 else r.choice(pool) for x in b] + [b"tail" + bytes(3)] for v, b in old.items()}
    return old, new


def test_dump_in_full_order(spark):
    """hole, match, state, intra, zero, data; and what is received makes the new volume."""
    old, new = volumes()
    frame = lambda x: C.blocks(spark.createDataFrame([(v, bytearray(b"".join(b))) for v, b in x.items()], "volume_id long, data binary"), 16)
    blocks, before = frame(new), frame(old)
    extents = spark.createDataFrame([(v, 0, 64) for v in range(8)] + [(v, 80, 500) for v in range(8)], "volume_id long, start long, end long")
    had = before.select("volume_id", "offset", "length", H.sha("data").alias("digest"))
    kinds = P.classify_dump(blocks, had.where("volume_id < 3"), had.where("volume_id >= 6"), extents, intra=3, width=32)
    want = {}
    for v, b in new.items():
        cache: OrderedDict = OrderedDict()
        for i, x in enumerate(b):
            same = i < len(old[v]) and old[v][i] == x
            if i == 4:
                want[v, i] = ("hole", None)
            elif same and v < 3:
                want[v, i] = ("match", None)
            elif same and v >= 6:
                want[v, i] = ("state", None)
            elif x in cache:
                want[v, i] = ("intra", cache[x])
            else:
                cache[x] = i
                if len(cache) > 3:
                    cache.popitem(last=False)
                want[v, i] = ("zero" if not any(x) else "data", None)
    assert {(r.volume_id, r.seq): (r.kind, r.ref_seq) for r in kinds.collect()} == want
    assert {k for k, _ in want.values()} == {"hole", "match", "state", "intra", "zero", "data"}
    # Without the intra test nothing but holes differs from the new volume once the frames are in.
    kinds = P.classify_dump(blocks, had.where("volume_id < 3"), had.where("volume_id >= 6"))
    none = spark.createDataFrame([], "volume_id long, start long, end long")
    got = P.after(before.select("volume_id", "offset", "data"), P.receive(P.frames(blocks, kinds), none))
    out = defaultdict(bytes)
    for r in got.orderBy("volume_id", "offset").collect():
        out[r.volume_id] += bytes(r.data)
    assert out == {v: b"".join(b) for v, b in new.items()}


def test_receiver_skips_checks_and_logs(spark):
    x, zero = b"data", 4
    ok = int(H.crc32c_many([x])[0])
    sha = hashlib.sha256(x).hexdigest()
    rows = [(1, 0, 0, 4, ok, sha, x, 4), (1, 1, 4, 0, 0, None, None, zero), (1, 2, 8, 0, 0, None, None, zero), (1, 3, 12, 4, ok + 1, sha, x, 4), (1, 4, 16, 4, ok, "0" * 64, x, 4), (1, 5, -4, 4, ok, sha, x, 4), (1, 6, 20, 3, ok, sha, x, 4), (1, 7, 2**63 - 2, 4, ok, sha, x, 4), (1, 8, 24, 0, 5, None, None, zero), (1, 9, 28, 4, ok, None, x, 4)]
    sent = spark.createDataFrame([(*r[:6], None if r[6] is None else bytearray(r[6]), r[7]) for r in rows], "volume_id long, seq long, offset long, length int, crc long, digest string, data binary, size int")
    log = spark.createDataFrame([(1, 0, 4)], "volume_id long, start long, end long")
    got = P.receive(sent, log, width=16)
    assert {r.seq: (r.action, r.problem) for r in got.collect()} == {0: ("skip", None), 1: ("zero", None), 2: ("zero", None), 3: ("bad", "crc"), 4: ("bad", "digest"), 5: ("bad", "offset"), 6: ("bad", "length"), 7: ("bad", "offset"), 8: ("bad", "crc"), 9: ("write", None)}
    assert {(r.start, r.end, r.kind) for r in P.written_ranges(got).collect()} == {(4, 12, "zero"), (28, 32, "data")}
    state = spark.createDataFrame([(1, 28, sha)], "volume_id long, offset long, digest string")
    assert {r.seq: r.action for r in P.receive(sent, log, state, 16).collect()}[9] == "same"


def test_twice_applied_is_once(spark):
    old, new = volumes(5)
    frame = lambda x: C.blocks(spark.createDataFrame([(v, bytearray(b"".join(b))) for v, b in x.items()], "volume_id long, data binary"), 16).select("volume_id", "seq", "offset", "length", "data")
    got = P.receive(P.frames(frame(new), P.classify_dump(frame(new))), spark.createDataFrame([], "volume_id long, start long, end long"))
    once = P.after(frame(old).select("volume_id", "offset", "data"), got)
    rows = lambda d: Counter((r.volume_id, r.offset, bytes(r.data)) for r in d.collect())
    assert rows(P.after(once, got)) == rows(once)
    # What the log of the first time has is skipped the second time.
    again = P.receive(P.frames(frame(new), P.classify_dump(frame(new))), P.written_ranges(got))
    assert {r.action for r in again.collect()} == {"skip"}


# -- manifests ---------------------------------------------------------------------------------------
def test_first_and_last_of_a_key(spark):
    rows = [(r, f"d{r % 4}", r * 7 % 11, r % 3) for r in range(40)]
    d = spark.createDataFrame(rows, "slot long, digest string, offset long, length int")
    want = {}
    for s, g, o, n in sorted(rows):
        if n and g not in want:
            want[g] = (s, o)
    assert {r.digest: (r.slot, r.offset) for r in M.collect_garbage(d, ["digest"], ["slot"]).collect()} == want
    last = {g: max(x for x in rows if x[1] == g) for _, g, *_ in rows}
    assert {r.digest: tuple(r) for r in M.upsert(d, ["digest"], "slot").collect()} == last


# -- queues, caches ----------------------------------------------------------------------------------
def queue(failures, most, step=1):
    """The sends by a plain clock."""
    out, ready, delayed, flying, fresh, tries, now, left = [], [], [], [], sorted(failures), Counter(), 0, dict(failures)
    while fresh or ready or delayed or flying:
        for t in flying:
            if left[t]:
                left[t] -= 1
                delayed.append((now + 10 * 2 ** (tries[t] - 1), t))
        flying = []
        for x in sorted(delayed):
            if x[0] <= now:
                heapq.heappush(ready, x[1])
        delayed = [x for x in delayed if x[0] > now]
        while len(flying) < most and (ready or fresh):
            t = heapq.heappop(ready) if ready else fresh.pop(0)
            tries[t] += 1
            flying.append(t)
            out.append((len(out), t, tries[t], now, not left[t]))
        now = now + step if flying or not delayed else max(now + step, min(delayed)[0])
    return out


def test_work_queue_waits_and_tries_again(spark):
    r = random.Random(3)
    queues = {q: {t: r.choice([0, 0, 0, 1, 2, 5]) for t in r.sample(range(200), 30)} for q in range(3)}
    d = spark.createDataFrame([(q, t, f) for q, x in queues.items() for t, f in x.items()], "q long, task long, failures long")
    got = defaultdict(list)
    for x in T.work_queue(d, "q", 1 << 18, 1 << 16).orderBy("seq").collect():
        got[x.q].append(tuple(x)[1:])
    assert got == {q: queue(x, 4) for q, x in queues.items()}
    assert all(sum(s[4] for s in got[q]) == 30 for q in queues)
    assert T.window_size(1, 0) == 1 and T.window_size(1 << 20, 1 << 16) == 16


def test_signature_cache_steps(spark):
    steps = [(1, i, k, t, s) for i, (k, t, s) in enumerate([("a", 0, 1), ("a", 5, 1), ("a", 14, 1), ("a", 30, 1), ("b", 31, 1), ("c", 32, 1), ("a", 33, 1), ("b", 34, 2), ("b", 35, 2)])]
    d = spark.createDataFrame(steps, "g long, n long, key string, at long, size long")
    got = [(r.hit, r.why) for r in T.signature_cache(d, "g", "n", 10.0, 2).orderBy("n").collect()]
    assert got == [(False, "miss"), (True, None), (True, None), (False, "expired"), (False, "miss"), (False, "miss"), (False, "miss"), (False, "miss"), (True, None)]


# -- streams -----------------------------------------------------------------------------------------
def test_stream_applies_each_batch_once(spark, tmp_path):
    """Files come one by one, the sink fails in between, and a batch that comes twice is applied once."""
    folder, top = str(tmp_path / "log"), str(tmp_path / "top")
    for i in range(4):
        spark.createDataFrame([(k, i * 10 + k) for k in range(5)], "k long, version long").coalesce(1).write.mode("append").parquet(folder)
    seen, failed = [], []

    def apply(batch, n):
        if n == 2 and not failed:
            failed.append(n)
            raise RuntimeError("lost")
        seen.append((n, batch.count()))

    sink = Z.acknowledged(apply, top)
    starts = Z.run(Z.log_stream(spark, folder, "*.parquet", 1), sink, top, attempts=3)
    assert starts == 2 and failed == [2] and [n for n, _ in seen] == [0, 1, 2, 3] and sum(c for _, c in seen) == 20
    sink(spark.range(9), 1)  # the same batch again
    assert len(seen) == 4
    with pytest.raises(Exception, match="always"):
        Z.run(Z.log_stream(spark, folder, "*.parquet", 1), lambda b, n: (_ for _ in ()).throw(RuntimeError("always")), str(tmp_path / "other"), attempts=2)


def test_stream_watches_a_limit(spark, tmp_path):
    folder = str(tmp_path / "usage")
    spark.createDataFrame([(i, i * 10.0) for i in range(11)], "id long, usage double").write.parquet(folder)
    got = Z.watch(Z.log_stream(spark, folder, "*.parquet"), "usage", 80.0, str(tmp_path / "top"))
    assert sorted(r.id for r in got.collect()) == [8, 9, 10]
    # A second run finds nothing new, and repeats nothing.
    assert Z.watch(Z.log_stream(spark, folder, "*.parquet"), "usage", 80.0, str(tmp_path / "top")).count() == 3


@pytest.mark.parametrize("master,fails", [("local[4]", False), ("local", False), ("local-cluster[2,1,1024]", True), ("spark://host:7077", True), ("yarn", True)])
def test_no_own_folder_on_a_cluster(master, fails):
    """Where spark.checkpoint.dir is unset, only local mode gets a folder of its own."""
    from types import SimpleNamespace

    from blockweave.sources.volumes import shared

    at = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: at[-1] if at else None, setCheckpointDir=at.append)
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d))
    if fails:
        with pytest.raises(ValueError, match="share"):
            shared(session)
    else:
        assert shared(session) == at[0]
    named = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: "hdfs:///shared"))
    at.clear()
    assert shared(named) == "hdfs:///shared"


def test_handshakes_are_read_in_one_pass(spark):
    """Fields of long lines are found once, not once for each pair of tokens; of repeated ones the last counts, with a value or without."""
    line = "BW/1\tblock:1  " + " ".join(f"x{i}:{i} level:{i}" for i in range(500)) + " crc32c dedup:a:b resume:r resume transports:a,, ,b block:7\n"
    rows = spark.createDataFrame([(line,), ("BX/1 level:x",), (None,), ("",)] * 50, "line string").repartition(4)
    began = time.time()
    got = {(r.h.problem, r.h.block, r.h.level, r.h.dedup, r.h.resume, r.h.crc32c, tuple(r.h.transports), r.h.compress) for r in rows.select(S.parse_handshake(F.col("line"), "BW/1").alias("h")).collect()}
    assert got == {(None, 7, 499, "a:b", "", True, ("a",), "none"), ("protocol", 0, 0, "", "", False, (), "none"), (None, 0, 0, "", "", False, (), "none")} and time.time() - began < 20


def test_entropy_of_windows(spark):
    """As counting says, at ends and over long volumes, which take seconds."""
    r = random.Random(3)
    long_ = r.randbytes(6 << 20)
    data = {1: b"", 2: None, 3: b"a" * 61, 4: bytes(range(64)) + b"xxy", 5: long_}
    began = time.time()
    rows = T.window_entropy(spark.createDataFrame(list(data.items()), "volume_id long, data binary")).collect()
    took = time.time() - began
    want = {}
    for k, d in data.items():
        for at in range(0, min(len(d or b""), 6400), 64):
            w = d[at : at + 64]
            want[k, at] = -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())
    got = {(x.volume_id, x.at): x.entropy for x in rows}
    assert len(rows) == 1 + 2 + len(long_) // 64 and all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and took < 20


def test_sizes_as_printf_rounds_them(spark):
    ns = [999, 1000, 1050, 1150, 1250, 1350, 1450, 9950, 999_949, 999_950, 2_250_000, 1_000_000_050, 10**12 - 1, 10**12, 4 * 10**12 + 50_000_000, 2**62]
    unit = lambda n, units: next((f"{n / float(1000**i):.1f} {u}B" for i, u in enumerate(units, 1) if n < 1000 ** (i + 1) or i == len(units)))
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    for units in ("kMGTPE", "kMG"):
        got = {r.n: r.s for r in df.select("n", S.format_bytes(F.col("n"), units).alias("s")).collect()}
        assert got == {n: f"{n} B" if n < 1000 else unit(n, units) for n in ns}


@pytest.mark.parametrize("name, source, key, keys", [("format_bytes", "orders", "o_orderkey", (1, 999_999, 1_000_139, 9_000_000)), ("disk_signatures", "supplier", "s_suppkey", (1, 4294, 4296, 60_001, 5_000_002))])
def test_keys_of_large_tables(spark, tmp_path, name, source, key, keys):
    """The query equals its SQL for keys past those of the small tables too."""
    import duckdb

    from blockweave.plans.catalog import ORACLES

    at = tmp_path / f"{source}.parquet"
    rows = spark.createDataFrame([(k, f"Supplier {k}") for k in keys], f"{key} long, s_name string")
    rows.write.parquet(str(at))
    want = duckdb.connect().execute(ORACLES[name].replace(f"FROM {source}", f"FROM '{at}/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_numbers_keep_their_low_bytes(spark):
    row = spark.range(1).select(X.number_bytes(F.lit(0x1_0203_0405), 4).alias("a"), X.number_bytes(F.lit(258), 2).alias("b")).first()
    assert (bytes(row.a), bytes(row.b)) == (b"\x05\x04\x03\x02", b"\x02\x01")


def test_long_logs_are_read_in_one_pass(spark):
    """A log's rows don't each copy the log."""
    n = 60_000
    ranges = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 100).cast("long").alias("start"), (i * 100 + 50).cast("long").alias("end")))
    head = F.struct(*(F.lit(7).cast("long").alias(f) if f in X._NUMBERS else F.lit("x").alias(f) for f, _ in X.LOG_FIELDS[1:]))
    began = time.time()
    logs = spark.range(4).select(F.col("id").alias("log_id"), F.concat(X.log_bytes(head, ranges), F.lit(b"torn")).alias("data"))
    got = X.log_ranges(logs).groupBy("log_id").agg(F.count("*").alias("n"), F.sum((F.col("start") == F.col("pos") * 100).cast("int") * (F.col("end") == F.col("start") + 50).cast("int")).alias("right")).collect()
    assert [(r.n, r.right) for r in got] == [(n, n)] * 4 and time.time() - began < 20
