"""Volumes in parts: cuts, checksums and hashes by many tasks equal those of one; ranges of any length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.functions import crc, trees
from blockweave.operators import chunking as C
from blockweave.operators import ranges as R
from blockweave.operators import segments as G


def mixed(n, seed=1):
    """Random bytes, zeros, a repeated pattern, text of few letters."""
    r = np.random.default_rng(seed)
    out = [r.integers(0, 256, n // 4, np.uint8), np.zeros(n // 8, np.uint8), np.tile(np.arange(100, dtype=np.uint8), n // 800 + 1), r.integers(97, 103, n // 4, np.uint8)]
    out.append(r.integers(0, 256, max(0, n - sum(map(len, out))), np.uint8))
    return np.concatenate(out)[:n].tobytes()


def slow_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (crc.POLY if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@pytest.mark.parametrize("sizes", [(64, 256, 1024), (256, 1024, 4096), (100, 100, 300)])
def test_walks_from_any_entry_equal_the_cutter(sizes):
    cutter = C.Cutter(*sizes)
    data = np.frombuffer(mixed(30_000), np.uint8)
    walk = G.Walk(cutter, data)
    entries = np.arange(0, 1500, 7)
    limit = 20_000
    at, n = walk.leaves(entries, limit)
    for e, a, k in zip(entries.tolist(), at.tolist(), n.tolist(), strict=True):
        ends = [e + x for x in cutter.cuts(data[e:])]
        past = next(i for i, x in enumerate(ends) if x >= limit)
        assert (a, k) == (ends[past], past + 1)


@pytest.mark.parametrize("segment,part", [(4096, 1000), (8192, 8192), (5000, 20_001)])
def test_parts_are_cut_as_a_whole(spark, segment, part):
    vols = [(1, mixed(70_000)), (2, b""), (3, b"\x00" * 50_000), (4, mixed(4097, 2)), (5, mixed(300, 3)), (6, mixed(segment + 1, 4)), (7, mixed(2 * segment + 4096, 5)), (None, mixed(segment, 6))]
    df = spark.createDataFrame(vols, "volume_id long, data binary")
    want = sorted(((r.volume_id or -1, r.seq, r.offset, r.length, bytes(r.data)) for r in C.cdc_chunks(df, 256, 1024, 4096).collect()))
    got = G.cdc_chunks_of_parts(G.parts(df, part), 256, 1024, 4096, segment=segment)
    assert sorted(((r.volume_id or -1, r.seq, r.offset, r.length, bytes(r.data)) for r in got.collect())) == want


def test_one_volume_of_64_mb_in_many_tasks(spark, tmp_path):
    size, part = 64 << 20, 4 << 20
    raw = mixed(size, 9)
    rows = [(1, at, raw[at : at + part]) for at in range(0, size, part)]
    path = str(tmp_path / "parts")
    spark.createDataFrame(rows, "volume_id long, start long, data binary").repartition(8, "start").write.parquet(path)
    pieces = spark.read.parquet(path)
    got = G.cdc_chunks_of_parts(pieces, 4096, 8192, 16384, segment=8 << 20).withColumn("task", F.spark_partition_id()).select("seq", "offset", "length", "task", F.crc32("data").alias("crc")).collect()
    ends = C.Cutter(4096, 8192, 16384).cuts(np.frombuffer(raw, np.uint8))
    got.sort()
    assert [r.offset + r.length for r in got] == ends and [r.seq for r in got] == list(range(len(ends)))
    assert len({r.task for r in got}) > 1
    import zlib

    assert all(r.crc == zlib.crc32(raw[r.offset : r.offset + r.length]) for r in got[::37])
    whole = crc.combined(pieces.withColumn("length", F.octet_length("data")).withColumn("crc32c", crc.crc32c("data")), ["volume_id"], offset="start").collect()
    assert [(r.size, r.crc32c) for r in whole] == [(size, int(crc.crc32c_many([raw])[0]))]
    assert [(r.size, r.blake3) for r in trees.blake3_of_parts(pieces, ["volume_id"], part).collect()] == [(size, trees.blake3_many([raw])[0].hex())]


def test_broken_parts_are_an_error(spark):
    for starts in ([(0, b"a" * 5000), (6000, b"b" * 100)], [(0, b"a" * 5000), (4000, b"b" * 3000)], [(10, b"a" * 5000)]):
        df = spark.createDataFrame([(1, s, d) for s, d in starts], "volume_id long, start long, data binary")
        with pytest.raises(Exception, match="overlap or leave a gap"):
            G.cdc_chunks_of_parts(df, 64, 256, 1024, segment=4096).collect()
    with pytest.raises(ValueError, match="segment"):
        G.cdc_chunks_of_parts(df, 64, 256, 1024, segment=100)


def test_crc32c_by_combination():
    r = random.Random(1)
    blobs = [r.randbytes(n) for n in (*range(20), 63, 64, 65, 777, 1024, *(r.randrange(400) for _ in range(60)))]
    assert crc.crc32c_many(blobs).tolist() == [slow_crc(b) for b in blobs]
    assert crc.crc32c_many([b"123456789"]).tolist() == [0xE3069283] and crc.crc32c_many([b"\x00" * 32, b"\xff" * 32]).tolist() == [0x8A9136AA, 0x62A8AB43]
    big = r.randbytes(1 << 20)
    import time

    began = time.thread_time()
    whole = int(crc.crc32c_many([big])[0])
    assert time.thread_time() - began < 1
    for n in (0, 1, 99_999, 1 << 20):
        a, b = crc.crc32c_many([big[:n], big[n:]])
        assert int(crc.combine(a, b, len(big) - n)[0]) == whole


def test_crc32c_of_volumes_from_blocks(spark):
    r = random.Random(2)
    vols = {1: r.randbytes(10_000), 2: b"x", 3: b"\x00" * 5000, None: b"abc"}
    blocks = [(v, at, min(97, len(d) - at), int(crc.crc32c_many([d[at : at + 97]])[0])) for v, d in vols.items() for at in range(0, len(d), 97)]
    blocks += [(4, 0, 5, 1), (4, 10, 5, 1), (5, 0, 0, 0), (1, 3, 0, None)]
    r.shuffle(blocks)
    got = {x.volume_id: (x.size, x.crc32c) for x in crc.combined(spark.createDataFrame(blocks, "volume_id long, offset long, length int, crc32c long"), ["volume_id"]).collect()}
    assert got == {v: (len(d), slow_crc(d)) for v, d in vols.items()} | {4: (15, None)}
    cells = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "data binary").select(crc.crc32c("data")).collect()
    assert [c[0] for c in cells] == [0xE3069283, None, 0]


# Published values: bytes 0, 1, .. 250, 0, 1, .. of each length.
BLAKE3 = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3073: "7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}
KEYED = {0: "92b2b75604ed3c76", 1: "6d7878dfff2f4856", 1024: "75c46f6f3d9eb4f5", 1025: "357dc55de0c7e382"}


def counted(n):
    return bytes(i % 251 for i in range(n))


def test_blake3_of_published_values(spark):
    assert [d.hex() for d in trees.blake3_many([counted(n) for n in BLAKE3])] == list(BLAKE3.values())
    assert [d.hex()[:16] for d in trees.blake3_many([counted(n) for n in KEYED], b"whats the Elvish word for friend")] == list(KEYED.values())
    assert trees.blake3_many([b"x" * 3000], b"short") == trees.blake3_many([b"x" * 3000], b"short" + b"\x00" * 27)
    got = spark.createDataFrame([(counted(2049),), (None,)], "data binary").select(trees.blake3("data")).collect()
    assert [r[0] for r in got] == [BLAKE3[2049], None]


@pytest.mark.parametrize("run", [2, 4, 1024])
def test_blake3_of_parts(spark, monkeypatch, run):
    monkeypatch.setattr(trees, "RUN", run)
    monkeypatch.setattr(trees, "LEVELS", 8)
    rows, want = [], {}
    for v, n in enumerate([0, 1, 1024, 1025, 2048, 2049, 4096, 5000, 8192, 31744, 102400, 51 * 2048 + 1]):
        rows += [(v, at, counted(n)[at : at + 2048]) for at in range(0, max(n, 1), 2048)]
        want[v] = (n, trees.blake3_many([counted(n)])[0].hex())
    rows += [(90, 2048, b"x" * 2048), (91, 0, b"x" * 100), (91, 2048, b"x"), (92, 0, b"x" * 2048), (92, 0, b"x" * 2048), (93, 0, None)]
    want |= {90: (4096, None), 91: (2049, None), 92: (2048, None), 93: (0, BLAKE3[0])}
    random.Random(3).shuffle(rows)
    got = trees.blake3_of_parts(spark.createDataFrame(rows, "volume_id int, start long, data binary").repartition(4), ["volume_id"], 2048)
    assert {r.volume_id: (r.size, r.blake3) for r in got.collect()} == want
    for size in (1000, 512, 3072):
        with pytest.raises(ValueError, match="power of two"):
            trees.blake3_of_parts(got, ["volume_id"], size)


def test_md4_of_published_values(spark):
    known = {b"": "31d6cfe0d16ae931b73c59d7e0c089c0", b"a": "bde52cb31de33e46245e05fbdbd6fb24", b"abc": "a448017aaf21d8525fc10ae87aa6729d", b"message digest": "d9130a8164549fe818874806e1c7014b", b"1234567890" * 8: "e33b4ddc9c38f2199c3e7b164fcc0536"}
    assert [d.hex() for d in trees.md4_many(list(known))] == list(known.values())
    got = spark.createDataFrame([(k,) for k in known] + [(None,)], "data binary").select(trees.md4("data")).collect()
    assert [r[0] for r in got] == [*known.values(), None]


def test_dyadic_intervals(spark):
    pairs = [(0, 1), (0, 16), (3, 70), (5, 5), (0, 1 << 20), (1, (1 << 20) + 3), (2**43 - 1, 2**43 + 7), (1, 2**60 - 1)]
    for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", R.dyadic(F.col("a"), F.col("b")).alias("d")).collect():
        got = sorted((x.at * 4**x.level, (x.at + 1) * 4**x.level) for x in r.d)
        assert [y for _, y in got[:-1]] == [x for x, _ in got[1:]]
        assert (not got and r.a >= r.b) or (got[0][0], got[-1][1]) == (r.a, r.b)
    mib = 1 << 20
    long = spark.createDataFrame([(1, 5 * mib + 17, (1 << 40) + 5 * mib + 17)], "k int, start long, end long")
    assert R.covers(long, ["k"], mib).count() < 100


@pytest.mark.parametrize("width", [1, 64, 4096])
def test_contained_equals_all_pairs(spark, width):
    r = random.Random(width)
    blocks = [(r.randrange(3), r.randrange(5000), r.randrange(1, 200)) for _ in range(400)] + [(None, 5, 5), (1, 2**62, 1 << 30)]
    ranges = [(r.randrange(3), a := r.randrange(5000), a + r.randrange(-5, 700)) for _ in range(30)] + [(1, 100, 2**62 + (1 << 31)), (None, 0, 100), (2, 0, 0)]
    got = R.contained(spark.createDataFrame(blocks, "k int, offset long, length long"), spark.createDataFrame(ranges, "k int, start long, end long"), ["k"], width)
    want = [b for b in blocks if any(k is not None and k == b[0] and a <= b[1] and b[1] + b[2] <= e for k, a, e in ranges)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert R.contained(got, spark.createDataFrame([], "k int, start long, end long"), ["k"], width).count() == 0


def test_queries_in_parts(spark):
    import __spark_entry__

    sf, q = "/root/testdata/sf0.001", __spark_entry__.queries()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(q["cdc_chunks_parts"](spark, sf)) == rows(q["cdc_chunks"](spark, sf))
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert rows(q["blake3_volumes"](spark, sf)) == sorted((k, len(t), trees.blake3_many([t])[0].hex()) for k, t in texts.items())
    blocks = [(k, i, t[i * 4096 : (i + 1) * 4096]) for k, t in texts.items() for i in range(-(-len(t) // 4096))]
    assert rows(q["blake3_blocks"](spark, sf)) == sorted((k, i, trees.blake3_many([b])[0].hex()) for k, i, b in blocks)
    md4 = {(r.volume_id, r.seq): (r.size, r.strong) for r in q["rsync_signatures_md4"](spark, sf).collect()}
    for (k, i), (size, strong) in md4.items():
        assert strong == trees.md4_many([texts[k][i * size : (i + 1) * size]])[0].hex()
    assert set(md4) == {(r.volume_id, r.seq) for r in q["rsync_signatures"](spark, sf).collect()}


@pytest.mark.parametrize("width", [32, 1000])
def test_holes_under_extents_of_any_length(spark, width):
    r = random.Random(width)
    blocks = [(v, at, 64 if at < 1920 else 10) for v in range(6) for at in range(0, 2000, 64)] + [(7, 0, 0), (8, 1 << 40, 64)]
    extents = [(r.randrange(6), a := r.randrange(0, 2100), a + r.choice([0, 1, 5, 63, 64, 65, 300])) for _ in range(18)] + [(8, 5, 1 << 50), (5, 0, 0)]
    got = C.holes(spark.createDataFrame(blocks, "volume_id int, offset long, length int"), spark.createDataFrame(extents, "volume_id int, start long, end long"), width)
    want = sorted((v, o, n, not any(x == v and s < o + n and z > o and z > s for x, s, z in extents) or n == 0) for v, o, n in blocks)
    assert sorted(map(tuple, got.select("volume_id", "offset", "length", "hole").collect())) == want
