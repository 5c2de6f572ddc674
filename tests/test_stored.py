"""Stored tables, trees of digests, bucketed joins, folds over streams."""

import glob
import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from blockweave.operators import manifest as M
from blockweave.operators import merkle as K
from blockweave.operators import ranges as R
from blockweave.sources import stored
from blockweave.streaming import stateful as W

ENTRY = "volume_id long, seq long, offset long, length int, digest string"


def entries(spark, volumes, blocks, salt=""):
    d = spark.range(volumes).withColumnRenamed("id", "volume_id").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return d.select("volume_id", "seq", (F.col("seq") * 1024).alias("offset"), F.lit(1024).alias("length"), F.sha2(F.concat_ws("/", "volume_id", "seq", F.lit(salt)), 256).alias("digest"))


def files(top):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{top}/**/*.parquet", recursive=True)}


def test_stored_table_changes_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    t = stored.StoredTable(spark, path, parts=8)
    with pytest.raises(ValueError, match="nothing"):
        t.read()
    first = entries(spark, 20, 3)
    t.replace(first)
    rows = lambda d: sorted(map(tuple, d.select("volume_id", "seq", "digest").collect()), key=str)
    assert rows(t.read()) == rows(first)
    before = files(path)
    new = entries(spark, 20, 4, "new")
    keys = spark.createDataFrame([(3,), (3,), (7,), (99,)], "volume_id long")
    stored.regenerated(t, new, keys)
    want = [r for r in rows(first) if r[0] not in (3, 7)] + [r for r in rows(new) if r[0] in (3, 7)]
    assert rows(t.read()) == sorted(want, key=str)
    assert all(files(path)[f] == before[f] for f in before)  # older files are untouched,
    touched = {r[0] for r in keys.select(t.part(F.col("volume_id"))).distinct().collect()}
    added = {f.split("part_=")[1].split("/")[0] for f in files(path) if f not in before}
    assert added <= set(map(str, touched))  # and only the parts of the keys have new ones
    now = rows(t.read())
    with pytest.raises(Exception, match="broken"):
        t.update(new.withColumn("digest", F.when(F.col("seq") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("digest"))), keys)
    with pytest.raises(Exception, match="broken"):
        t.replace(new.withColumn("digest", F.when(F.col("seq") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("digest"))))
    assert rows(t.read()) == now  # a write that fails leaves the old table
    held = t.read()
    t.replace(t.read().where("volume_id < 5"))
    assert rows(held) == now and {r[0] for r in rows(t.read())} == set(range(5))
    assert t.vacuum() >= 3 and {r[0] for r in rows(t.read())} == set(range(5))
    t.update(new, spark.createDataFrame([(i,) for i in range(5)], "volume_id long").where("volume_id > 9"))
    t.update(new.where("volume_id < 0"), spark.createDataFrame([(0,), (1,)], "volume_id long"))
    assert {r[0] for r in rows(t.read())} == {2, 3, 4}
    with pytest.raises(ValueError, match="parts"):
        stored.StoredTable(spark, path, parts=9).read()
    t.replace(first.where("volume_id < 0"))
    assert t.read().count() == 0


def test_null_keys_in_stored_tables(spark, tmp_path):
    t = stored.StoredTable(spark, str(tmp_path / "t"), parts=4)
    t.replace(spark.createDataFrame([(None, 1), (1, 2)], "volume_id long, x int"))
    t.update(spark.createDataFrame([(None, 5)], "volume_id long, x int"), spark.createDataFrame([(None,)], "volume_id long"))
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, 2), (None, 5)]


def test_tree_descends_only_where_nodes_differ(spark, tmp_path):
    n, fan = 4096, 16
    old = entries(spark, 3, n)
    changed = {(0, 5), (0, 2000), (2, 4095)}
    hit = F.concat_ws("/", "volume_id", "seq").isin(*(f"{v}/{s}" for v, s in changed))
    new = old.withColumn("digest", F.when(hit, F.sha2(F.col("digest"), 256)).otherwise(F.col("digest")))
    for name, rows in (("a", old), ("b", new)):
        K.store(K.build(rows, fan, K.levels_for(n, fan)), str(tmp_path / name))
    visited = []
    got = K.diff(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")), fan, visited)
    assert sorted(map(tuple, got.collect())) == [(v, s, "changed") for v, s in sorted(changed)]
    assert visited[0] == 3 and len(visited) == 4 and sum(visited) <= 3 + len(changed) * fan * 3


@pytest.mark.parametrize("fan", [2, 5])
def test_tree_diff_equals_full_join(spark, fan):
    r = random.Random(fan)
    a = [(v, s, f"d{r.randrange(4)}") for v in range(6) for s in range(r.randrange(0, 40))] + [(None, 0, "x")]
    b = [(v, s, d if r.random() < 0.9 else "other") for v, s, d in a if r.random() < 0.95] + [(9, s, "n") for s in range(7)] + [(0, 100, "far")]
    x, y = (spark.createDataFrame(t, "volume_id long, seq long, digest string").where("volume_id is not null") for t in (a, b))
    levels = K.levels_for(101, fan)
    got = K.diff(K.build(x, fan, levels), K.build(y, fan, levels), fan)
    want = M.diff_status(x, y, ["volume_id", "seq"]).where("status <> 'same'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert K.diff(K.build(x, fan), K.build(x, fan), fan).count() == 0 and K.diff(K.build(x.limit(0), fan), K.build(x.limit(0), fan), fan).count() == 0


def test_bucketed_manifest_is_joined_in_place(spark, tmp_path):
    name, by = "manifest_bucketed_test", ["volume_id", "offset"]
    spark.sql(f"drop table if exists {name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored.save_bucketed(entries(spark, 10, 8), name, str(tmp_path / "b"), by, 4)
        kept, new = spark.table(name), entries(spark, 10, 9).withColumn("digest", F.when(F.col("seq") == 1, "other").otherwise(F.col("digest")))
        plans = {"match": M.unchanged(new, kept, [*by, "digest"]), "verify": M.verify(kept, new), "diff": M.diff_status(kept, new, by)}
        assert plans["match"].count() == 70 and plans["verify"].count() == 10
        for join in ("verify", "diff"):
            plan = plans[join]._jdf.queryExecution().executedPlan().toString()
            side = plan[plan.index("Join") :]
            assert side.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in side  # the new side alone is shuffled
        latest = M.upsert(kept.withColumn("version", F.lit(1)), by, "version")
        assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString() and latest.count() == 80
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table if exists {name}")


def test_levels():
    assert [K.levels_for(n, 16) for n in (0, 1, 2, 16, 17, 256, 257)] == [0, 0, 1, 1, 2, 2, 3]


FRAMES = "volume_id long, seq long, offset long, length long, zero boolean"


def frames(seed=1):
    r = random.Random(seed)
    out = []
    for v in range(4):
        at = 0
        for s in range(r.randrange(5, 40)):
            n = r.choice([512, 1024, 100])
            out.append((v, s, at, n, r.random() < 0.6))
            at += n + (7 if r.random() < 0.1 else 0)
    return out


def test_folds_over_batches_equal_the_batch_result(spark, tmp_path):
    """Three runs over a growing folder, each started anew from the checkpoint; frames come again."""
    data, top = frames(), str(tmp_path)
    cuts = [(0, 6), (4, 17), (17, 99)]
    for i, (lo, hi) in enumerate(cuts):
        part = [f for f in data if lo <= f[1] < hi]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, FRAMES).repartition(3).write.parquet(f"{top}/frames/{i}")
        stream = W.frames_stream(spark, f"{top}/frames", FRAMES)
        synced = W.appended(W.syncs(stream.select("volume_id", "seq", "length"), 2000), top, "syncs")
        runs = W.appended(W.zero_runs(stream), top, "runs")
    whole = spark.createDataFrame(data, FRAMES)
    groups = R.sync_groups(whole, ["volume_id"], "seq", 2000).groupBy("volume_id", "sync").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum("length").alias("n")).where("n >= 2000")
    assert sorted(map(tuple, synced.collect())) == sorted((*r, "bytes") for r in map(tuple, groups.collect())) != []
    closed = defaultdict(list)
    for v, a, n, k in map(tuple, R.coalesce_runs(whole, ["volume_id"], "seq", keep=F.col("zero")).collect()):
        closed[v].append((a, n, k))
    ends = {v: max(s[2] + s[3] for s in data if s[0] == v) for v in closed}
    want = sorted((v, *r) for v, rs in closed.items() for r in rs if r[0] + r[1] < ends[v])  # a run at the end is still open
    assert sorted(map(tuple, runs.collect())) == want != []


def test_time_ends_what_bytes_do_not(spark, tmp_path):
    top, wait = str(tmp_path), 1500
    put = lambda i, rows: spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(f"{top}/frames/{i}")

    def go():
        stream = W.frames_stream(spark, f"{top}/frames", FRAMES)
        a = W.appended(W.syncs(stream.select("volume_id", "seq", "length"), 1000, wait), top, "syncs")
        b = W.appended(W.zero_runs(stream, wait), top, "runs")
        return sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))

    put(0, [(1, 0, 0, 400, True), (1, 1, 400, 400, True), (2, 0, 0, 1000, False)])
    syncs, runs = go()
    assert syncs == [(2, 0, 0, 0, 1000, "bytes")] and runs == []
    time.sleep(2 * wait / 1000)
    put(1, [(3, 0, 0, 10, False)])  # another volume's frame; the timers of the first are due
    syncs, runs = go()
    assert syncs == [(1, 0, 0, 1, 800, "time"), (2, 0, 0, 0, 1000, "bytes")] and runs == [(1, 0, 800, 2)]
    put(2, [(1, 2, 800, 300, True), (1, 3, 1100, 800, False)])  # counting starts anew
    syncs, runs = go()
    assert (1, 1, 2, 3, 1100, "bytes") in syncs and (1, 800, 300, 1) in runs


def test_save_leaves_the_old_table_if_it_fails(spark, tmp_path):
    from blockweave.sources.volumes import save

    path = str(tmp_path / "t")
    save(spark.range(5), path)
    with pytest.raises(Exception, match="broken"):
        save(spark.range(9).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id"))), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    save(spark.read.parquet(path).where("id < 3"), path)
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["t"]


def test_repeated_keys_of_lines(spark):
    from blockweave.functions import scalars as S

    got = spark.createDataFrame([("/dev/a1 : start=1, size=5, start=2, type=L",), ("/dev/a1 : start=1, start=x, size=5, type=L",)], "l string").select(S.partition_line(F.col("l"))).collect()
    assert [tuple(r[0]) if r[0] else None for r in got] == [(2, 6, "L"), None]
    assert spark.range(1).select(S.tokens_last(F.lit("a:1 b a:2"))).head()[0] == {"a": "2", "b": ""}


def test_sketches_within_their_error(spark):
    from blockweave.operators import sketches as N

    d = spark.range(60_000).select((F.col("id") % 3).alias("volume_id"), F.when(F.col("id") % 3 == 2, F.col("id") % 5000).otherwise(F.col("id") % 40_000).alias("x"))
    d = d.withColumn("digest", F.sha2(F.col("x").cast("string"), 256)).unionByName(spark.createDataFrame([(0, 1, None), (9, 1, ""), (8, 2, "one"), (8, 2, "one")], "volume_id long, x long, digest string"))
    got = N.dedup_ratio(N.build(d, ["volume_id"])).cache()
    exact = {r[0]: (r[1], r[2]) for r in d.where("digest <> ''").groupBy("volume_id").agg(F.count("*"), F.countDistinct("digest")).collect()}
    error = 3 / 2 ** (N.LG / 2)
    for r in got.collect():
        n, distinct = exact.pop(r.volume_id)
        assert r.n_chunks == n and abs(r.n_distinct - distinct) <= error * distinct and abs(r.ratio - (1 - distinct / n)) <= error
    assert not exact
    a, b = (got.where(F.col("volume_id") == v).select(F.col("sketch").alias(f"s{v}")) for v in (0, 1))
    pair = a.join(b, how="inner").select(N.shared("s0", "s1"), N.added("s0", "s1")).head()
    xs = [{r[0] for r in d.where((F.col("volume_id") == v) & F.col("digest").isNotNull()).select("x").distinct().collect()} for v in (0, 1)]
    union = len(xs[0] | xs[1])
    assert abs(pair[0] - len(xs[0] & xs[1])) <= error * union and abs(pair[1] - len(xs[0] - xs[1])) <= error * union
    whole = N.dedup_ratio(N.merged(got, [])).head()
    every = d.where("digest <> ''").agg(F.countDistinct("digest")).head()[0]
    assert abs(whole.n_distinct - every) <= error * every
    got.unpersist()


def test_sketches_in_parts_are_exact(spark):
    """Sets larger than a sketch: counts of their parts add up."""
    from blockweave.operators import sketches as N

    n = 60_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    parts = N.parts_for(n, lg=10)
    by = lambda d: N.build(d.withColumn("part", N.part_of(F.col("digest"), parts)), ["g", "part"], lg=10)
    a, b = by(df), by(df.where("crc32(digest) % 3 > 0")).select("g", "part", F.col("sketch").alias("new"))
    got = a.join(b, ["g", "part"], "left").groupBy("g").agg(F.sum(N.distinct(F.col("sketch"))).alias("n"), F.sum(N.shared(F.col("sketch"), F.col("new"))).alias("kept"))
    want = df.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.expr("crc32(digest) % 3 > 0")).alias("kept"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
