"""Data sources: images above 2 GiB by ranges, stores that commit whole or leave nothing, change tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from blockweave.operators import manifest as M
from blockweave.sources import device, records

MIB = 1 << 20


@pytest.fixture(scope="module")
def with_sources(spark):
    return device.register(spark)


def test_image_above_two_gib(with_sources, tmp_path):
    path, size = tmp_path / "disk.img", (5 << 29) + 777
    with path.open("wb") as f:
        f.truncate(size)
        for at in (0, (1 << 31) - 3, (1 << 31) + 5 * MIB, size - 700):
            f.seek(at)
            f.write(b"mark!!")
    read = with_sources.read.format("volume").option("path", str(path)).option("partition", 64 * MIB)
    assert read.load().rdd.getNumPartitions() == 41
    tail = read.option("start", 1 << 31).load().where(F.col("offset") >= 1 << 31)
    assert tail.rdd.getNumPartitions() == 9  # shares below the bound are not read
    got = tail.select("offset", "length", F.substring(F.col("data"), 1, 6).alias("head"), F.crc32("data").alias("crc")).collect()
    assert [r.offset for r in sorted(got)] == list(range(1 << 31, size, MIB)) and sum(r.length for r in got) == size - (1 << 31)
    by = {r.offset: bytes(r.head) for r in got}
    assert by[1 << 31] == b"k!!\x00\x00\x00" and by[(1 << 31) + 5 * MIB] == b"mark!!" and by[max(by)] == b"\x00" * 6
    few = read.option("start", 3 * MIB).option("end", 5 * MIB).load().where((F.col("offset") >= 3 * MIB) & (F.col("offset") < 5 * MIB))
    assert few.rdd.getNumPartitions() == 1 and sorted(r.offset for r in few.select("offset").collect()) == [3 * MIB, 4 * MIB]


def test_folder_of_images_in_small_blocks(with_sources, tmp_path):
    r = random.Random(1)
    content = {"a.img": r.randbytes(10_000), "b.img": b"", "c.img": b"x", "_skip": b"y"}
    for n, c in content.items():
        (tmp_path / n).write_bytes(c)
    got = with_sources.read.format("volume").option("path", f"file:{tmp_path}").option("block", 512).option("partition", 2048).load().collect()
    for n in ("a.img", "c.img"):
        mine = sorted((x.offset, bytes(x.data)) for x in got if x.volume == n)
        assert b"".join(d for _, d in mine) == content[n] and [o for o, _ in mine] == list(range(0, len(content[n]), 512))
    assert {x.volume for x in got} == {"a.img", "c.img"} and all(x.length == len(x.data) for x in got)
    for bad in ({"path": str(tmp_path / "none")}, {"path": str(tmp_path), "block": "512", "partition": "700"}, {"block": "512"}):
        with pytest.raises(Exception, match="none|whole number|path"):
            with_sources.read.format("volume").options(**bad).load().collect()


def _blocks(spark, volume, n, size=1000, value=7):
    return spark.range(n).select(F.lit(volume).alias("volume"), (F.col("id") * size).alias("offset"), F.lit(size).alias("length"), F.unhex(F.repeat(F.lit(f"{value:02x}"), F.lit(size))).alias("data"))


def _files(top):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names)


def test_store_is_replaced_whole(with_sources, tmp_path):
    path = str(tmp_path / "store")
    put = lambda df, mode: df.write.format("volume").mode(mode).option("path", path).save()
    get = lambda: with_sources.read.format("volume").option("path", path)
    put(_blocks(with_sources, "v", 50).repartition(4), "append")
    put(_blocks(with_sources, "w", 20).repartition(2), "append")
    got = get().load().groupBy("volume").agg(F.count("*").alias("n"), F.sum("length").alias("s")).collect()
    assert sorted(map(tuple, got)) == [("v", 50, 50_000), ("w", 20, 20_000)]
    assert get().load().where("volume = 'v' and offset >= 49000").count() == 1
    before = _files(path)
    broken = _blocks(with_sources, "x", 40).withColumn("length", F.when(F.col("offset") == 33_000, 5).otherwise(F.col("length"))).repartition(4)
    with pytest.raises(Exception, match="as many bytes as it says"):
        put(broken, "overwrite")
    assert _files(path) == before  # an abort leaves no file, and the old store stands
    assert get().load().count() == 70
    put(_blocks(with_sources, "y", 5, value=9), "overwrite")
    assert {r.volume for r in get().load().collect()} == {"y"} and not set(_files(path)) & {f for f in before if f.endswith(".arrow")}
    put(_blocks(with_sources, "y", 0), "overwrite")
    assert get().load().count() == 0


def test_first_write_that_fails_leaves_nothing(with_sources, tmp_path):
    path = str(tmp_path / "store")
    for bad in (F.col("offset") - 10_000, F.lit(None).cast("long")):
        with pytest.raises(Exception, match="offset"):
            _blocks(with_sources, "v", 30).withColumn("offset", bad).repartition(3).write.format("volume").mode("append").option("path", path).save()
        assert not os.path.exists(path)
    with pytest.raises(Exception, match="columns"):
        _blocks(with_sources, "v", 3).drop("length").write.format("volume").mode("append").option("path", path).save()


def test_store_is_read_in_several_tasks(with_sources, tmp_path):
    path = str(tmp_path / "store")
    _blocks(with_sources, "v", 300, 65_536).coalesce(1).write.format("volume").mode("append").option("path", path).save()
    read = with_sources.read.format("volume").option("path", path).option("block", 65_536).option("partition", 8 * MIB)
    vol = read.load()
    assert vol.rdd.getNumPartitions() >= 3 and vol.count() == 300
    assert read.option("end", 65_536).load().rdd.getNumPartitions() == 1 and vol.where("offset < 65536").count() == 1
    digests = vol.select("offset", "length", F.sha2("data", 256).alias("digest"))
    assert M.digest_of_digests(digests.withColumn("volume_id", F.lit(1)), ["volume_id"]).collect()[0].n_chunks == 300


def test_change_tables(with_sources, tmp_path):
    head = lambda sectors: b"".join(x.to_bytes(4, "little") for x in (0x70416E53, 1, 1, sectors))
    pairs = [(5, 9), (6, 10), (2**64 - 1, 3), (7, 0), (8, 1)]
    body = b"".join(x.to_bytes(8, "little") for p in pairs for x in p)
    raw = head(1).ljust(512, b"\x00") + body + b"torn"
    (tmp_path / "a.cow").write_bytes(raw)
    (tmp_path / "b.cow").write_bytes(head(2).ljust(1024, b"\x00"))
    read = with_sources.read.format("changes").option("path", str(tmp_path)).option("partition", 32).load()
    assert read.rdd.getNumPartitions() == 3
    got = device.changed(read).select("pos", "start", "end", "problem").collect()
    cells = with_sources.createDataFrame([("a.cow", raw)], "log_id string, data binary")
    assert sorted(map(tuple, got)) == sorted(map(tuple, records.change_records(cells, 512).drop("log_id").collect()))
    (tmp_path / "bad.cow").write_bytes(b"not a table at all")
    with pytest.raises(Exception, match="header"):
        with_sources.read.format("changes").option("path", str(tmp_path)).load().collect()
