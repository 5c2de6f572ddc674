"""The core operators against hand-made cases, DuckDB and brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.functions import scalars as S
from blockweave.functions.hashing import crc32c_many
from blockweave.operators import chunking as C
from blockweave.operators import delta as D
from blockweave.operators import manifest as M
from blockweave.operators import ranges as R
from blockweave.operators import state as T
from blockweave.plans import catalog, devices, parts  # noqa: F401  (they add their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def slow_cuts(data, low, avg, high, seed=0):
    """The cuts a byte at a time."""
    g, out, at = [int(x) for x in C.gear(seed)], [], 0
    bits = max(1, int(np.log2(avg)))
    while at < len(data):
        p, h, end = at + low, 0, min(len(data), at + high)
        while p < end:
            h = (h * 2 + g[data[p]]) % 2**64
            p += 1
            n = np.bincount(np.frombuffer(data[p - 64 : p], np.uint8))
            n = n[n > 0]
            poor = bool(-(n / 64 * np.log2(n / 64)).sum() < 4 - 1e-9)
            if h & ((1 << (bits + 2 * poor)) - 1) == 0:
                break
        at = min(p, len(data))
        out.append(at)
    return out


def test_cuts_known_and_brute_force():
    data = bytes(i % 256 for i in range(1024))
    cuts = C.Cutter(64, 128, 256).cuts(np.frombuffer(data, np.uint8))
    assert [0, *cuts[:-1]] == [0, 119, 216, 293, 375, 472, 549, 631, 728, 805, 887, 984]
    r = random.Random(7)
    for n in (0, 1, 63, 64, 65, 5000):
        for alphabet in (256, 4, 16):
            data = bytes(r.randrange(alphabet) for _ in range(n))
            for seed in (0, 5):
                got = C.Cutter(64, 128, 256, seed).cuts(np.frombuffer(data, np.uint8))
                assert got == slow_cuts(data, 64, 128, 256, seed)


def test_cutter_refuses_bad_sizes():
    for sizes in ((0, 64, 128), (32, 64, 128), (128, 64, 256), (64, 256, 128)):
        with pytest.raises(ValueError):
            C.Cutter(*sizes)


def test_crc32c():
    assert crc32c_many([b"123456789", b"", b"a"]).tolist() == [3808858755, 0, 0xC1D04330]


@pytest.mark.parametrize("size,n", [(0, 0), (1, 1), (1023, 1), (1024, 1), (1025, 2), (4096, 4)])
def test_blocks_at_the_edges(spark, size, n):
    got = C.blocks(spark.createDataFrame([(1, bytearray(size))], "volume_id long, data binary"), 1024).collect()
    assert len(got) == n and sum(r.length for r in got) == size


def test_apply_of_diff_is_the_new_volume(spark):
    r = random.Random(3)
    old = {v: bytes(r.randrange(3) for _ in range(r.randrange(0, 90))) for v in range(20)}
    new = {v: bytes(16) + b"x" * 16 + old[v][::-1] + old[(v + 1) % 20][:32] for v in range(20)}
    frame = lambda x: spark.createDataFrame([(v, bytearray(b)) for v, b in x.items()], "volume_id long, data binary")
    blocks = C.blocks(frame(new), 16)
    kinds = D.classify(blocks, M.build(frame(old), 16))
    sizes = frame(new).select("volume_id", F.octet_length("data").alias("size"))
    out = {}
    for row in D.apply(C.blocks(frame(old), 16), D.deltas(blocks, kinds), sizes).orderBy("volume_id", "offset").collect():
        out[row.volume_id] = out.get(row.volume_id, b"") + bytes(row.data)
    assert out == new and {k.kind for k in kinds.collect()} >= {"zero", "ref", "data"}


def test_ranges(spark):
    log = spark.createDataFrame([(1, 0, 2, 1), (1, 1, 4, 2), (1, 2, 0, 0), (1, 3, 9, 9)], "log_id long, pos long, origin_chunk long, snap_chunk long")
    got = [(r.start, r.end) for r in R.change_ranges(log, 4096).orderBy("pos").collect()]
    assert got == [(8192, 12288), (16384, 20480)]
    rows = spark.createDataFrame([(1, 0, 100), (1, 100, 200)], "k long, start long, end long")
    blocks = spark.createDataFrame([(1, 0, 100), (1, 50, 100), (1, 150, 50)], "k long, offset long, length long")
    assert {r.offset for r in R.contained(blocks, rows, ["k"], 64).collect()} == {0, 150}  # adjacent ranges are not one
    left = [(r.start, r.end) for r in R.resume_from(rows, 120).collect()]
    assert left == [(120, 200)]


def test_fifo_and_bucket(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate("abacab")], "g long, seq long, digest string")
    assert [r.hit for r in T.fifo_dedup(rows, "g", "seq", 2).orderBy("seq").collect()] == [False, False, True, False, False, False]
    asks = spark.createDataFrame([(1, 0.0, 5.0), (1, 0.0, 10.0)], "g long, at double, n double")
    assert sorted(r.wait for r in T.token_bucket(asks, "g", "at", "n", 1.0, 10.0).collect()) == [0.0, 5.0]


def test_sizes(spark):
    cases = {"1KB": 1000, "1KiB": 1024, "1.5MiB": 1572864, "1.1B": None, "1.1MiB": None, "-1G": None, "10XB": None, "": None, "9223372036854775807": 2**63 - 1, "9223372036854775808": None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", S.parse_size(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == cases


ORACLE = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({catalog.ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    clean = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=key)
    assert clean(map(tuple, got.select(*names).collect())) == clean(want)


def test_queries_without_sql_have_tests_of_their_own():
    """test_devices and test_parts hold these against plain loops."""
    assert set(catalog.QUERIES) - set(ORACLE) == {"cdc_chunks", "cdc_chunks_parts", "blake3_blocks", "blake3_volumes", "rsync_signatures_md4", "cdc_size_dist", "cdc_dedup_refs", "xxh3", "compress_decision", "work_queue", "signature_cache"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["source", "n_blocks", "n_bytes"]


def test_byte_runs_end_at_buffer_edges(spark):
    pairs = spark.createDataFrame([(1, b"aaaaaaaaaa", b"abbbbbbaab"), (2, b"xy", b"xz..."), (3, None, b"x"), (4, b"", b"")], "volume_id long, a binary, b binary")
    got = sorted(tuple(r) for r in D.byte_runs(pairs, 4).collect())
    assert got == [(1, 1, 3), (1, 4, 3), (1, 9, 1), (2, 1, 1)]
