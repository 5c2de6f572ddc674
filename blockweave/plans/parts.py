"""Queries over volumes in parts, tree hashes, long ranges and volume stores, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crc, trees
from ..functions.hashing import sha
from ..operators import delta as D
from ..operators import manifest as M
from ..operators import merkle as K
from ..operators import ranges as R
from ..operators import resume
from ..operators import segments as G
from ..operators import session as Q
from ..operators import sketches as N
from ..sources import device, stored
from ..sources import records as X
from ..sources.volumes import table
from ..streaming import stateful as W
from ..streaming.replay import scratch
from .catalog import _BLOCKS, _PAIR, ORACLES, B, docs, edited, query


@query()
def cdc_chunks_parts(spark, d):
    """The chunks of ``cdc_chunks``, of volumes that come in parts of 24 KiB and are cut by segments of 64 KiB in any task."""
    c = G.cdc_chunks_of_parts(G.parts(docs(spark, d), 24 * B), 256, 1024, 4096, segment=64 * B)
    return c.select("volume_id", "seq", "offset", "length", sha("data").alias("digest"))


_CRC = "list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 2197175160 * (c & 1))) ORDER BY i)"


@query(
    f"""WITH t AS (SELECT {_CRC} AS t FROM range(0, 256) AS r(i)), x AS (SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS x FROM documents WHERE octet_length(encode(text)) > 0)
    SELECT doc_id AS volume_id, CAST(len(x) AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS crc32c FROM x, t"""
)
def volume_crc32c(spark, d):
    """The CRC of each volume, put together from those of its blocks."""
    b = M.blocks(docs(spark, d), B).select("volume_id", "offset", "length", crc.crc32c("data").alias("crc32c"))
    return crc.combined(b, ["volume_id"])


@query()
def blake3_blocks(spark, d):
    return M.blocks(docs(spark, d), 4 * B).select("volume_id", "seq", trees.blake3("data").alias("blake3"))


@query()
def blake3_volumes(spark, d):
    """The hash of each volume, its parts hashed by any tasks."""
    return trees.blake3_of_parts(G.parts(docs(spark, d), 2 * B), ["volume_id"], 2 * B)


@query()
def rsync_signatures_md4(spark, d):
    return D.signatures(docs(spark, d), strong="md4").drop("weak")


_LONG = "SELECT user_id AS k, event_id * 1000003 AS s, event_id * 1000003 + CAST(power(2, 10 + event_id % 31) AS BIGINT) AS e FROM events WHERE event_id % 7 = 0"


@query(f"WITH r AS ({_LONG}), b AS (SELECT user_id AS k, event_id * 1000003 + 11 AS off FROM events) SELECT k, off AS \"offset\" FROM b WHERE EXISTS (SELECT 1 FROM r WHERE r.k = b.k AND off >= s AND off + 4096 <= e)")
def long_range_contains(spark, d):
    """Blocks inside ranges from 1 KiB to 1 TiB, each a few aligned intervals."""
    e = table(spark, d, "events")
    at = F.col("event_id") * 1000003
    r = e.where("event_id % 7 = 0").select(F.col("user_id").alias("k"), at.alias("start"), (at + F.pow(F.lit(2.0), 10 + F.col("event_id") % 31).cast("long")).alias("end"))
    b = e.select(F.col("user_id").alias("k"), (at + 11).alias("offset"), F.lit(4096).alias("length"))
    return R.contained(b, r, ["k"], 4096).select("k", "offset")


@query(f"WITH {_BLOCKS} SELECT CAST(volume_id AS VARCHAR) AS volume, count(*) AS n_blocks, CAST(sum(length) AS BIGINT) AS n_bytes, sha256(string_agg(digest, '' ORDER BY off)) AS root FROM m GROUP BY volume_id")
def stored_volumes(spark, d):
    """Volumes written to a store, read again and hashed."""
    device.register(spark)
    path = scratch(spark)
    M.blocks(docs(spark, d), B).select(F.col("volume_id").cast("string").alias("volume"), "offset", F.col("length").cast("int").alias("length"), "data").write.format("volume").mode("append").option("path", path).save()
    got = spark.read.format("volume").option("path", path).load().select("volume", "offset", "length", sha("data").alias("digest"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "digest")))
    return got.groupBy("volume").agg(F.count("*").alias("n_blocks"), F.sum("length").alias("n_bytes"), sha(F.concat_ws("", F.transform(parts, lambda p: p["digest"]))).alias("root"))


@query(f"WITH {_PAIR} SELECT coalesce(m.volume_id, e.volume_id) AS volume_id, CAST(coalesce(m.off, e.off) / {B} AS BIGINT) AS seq, CASE WHEN m.digest IS NULL THEN 'added' WHEN e.digest IS NULL THEN 'removed' ELSE 'changed' END AS status FROM m FULL JOIN e ON m.volume_id = e.volume_id AND m.off = e.off WHERE m.digest IS DISTINCT FROM e.digest")
def tree_changes(spark, d):
    """Blocks that an edit has changed, found from the tops of stored trees of digests."""
    old, new, top = M.build(docs(spark, d), B), M.build(edited(spark, d), B), scratch(spark)
    most = old.agg(F.max("seq")).union(new.agg(F.max("seq"))).agg(F.max("max(seq)")).head()[0]
    levels = K.levels_for(1 + (most or 0))
    for name, m in (("old", old), ("new", new)):
        K.store(K.build(m, levels=levels), f"{top}/{name}")
    return K.diff(spark.read.parquet(f"{top}/old"), spark.read.parquet(f"{top}/new"))


@query(
    f"""WITH {_PAIR}, stale AS (SELECT DISTINCT volume_id FROM (SELECT coalesce(m.volume_id, e.volume_id) AS volume_id, m.digest IS DISTINCT FROM e.digest AS x FROM m FULL JOIN e ON m.volume_id = e.volume_id AND m.off = e.off) WHERE x AND volume_id % 2 = 0)
    SELECT volume_id, off AS "offset", digest FROM e WHERE volume_id IN (SELECT volume_id FROM stale) UNION ALL SELECT volume_id, off, digest FROM m WHERE volume_id NOT IN (SELECT volume_id FROM stale)"""
)
def regenerate_in_place(spark, d):
    """A stored manifest of which the stale volumes with even numbers are rebuilt; the others' files stay."""
    entry = lambda v: M.build(v, B).select("volume_id", "offset", "digest")
    kept = stored.StoredTable(spark, scratch(spark), parts=16)
    kept.replace(entry(docs(spark, d)))
    actual = entry(edited(spark, d))
    stale = M.stale_volumes(kept.read(), actual).where("stale and volume_id % 2 = 0").select("volume_id")
    stored.regenerated(kept, actual, stale)
    return kept.read()


@query(ORACLES["verify_mismatch"])
def verify_bucketed(spark, d):
    """The stored manifest is bucketed by what it is joined on; only the actual blocks are shuffled."""
    path = scratch(spark)
    name = f"manifest_{path.rsplit('/', 1)[-1]}"
    stored.save_bucketed(M.build(docs(spark, d), B), name, path, ["volume_id", "offset"], 8)
    return M.verify(spark.table(name), M.build(edited(spark, d), B))


@query(f"WITH s AS ({ORACLES['sync_groups']}), l AS (SELECT doc_id AS volume_id, octet_length(encode(text)) AS n FROM documents) SELECT volume_id, sync AS number, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(least({B}, n - seq * {B})) AS BIGINT) AS bytes, 'bytes' AS why FROM s JOIN l USING (volume_id) GROUP BY volume_id, sync HAVING sum(least({B}, n - seq * {B})) >= 2500")
def stream_syncs(spark, d):
    """Syncs of a stream of frames that comes in two runs, the second from the checkpoint of the first."""
    top = scratch(spark)
    frames = M.blocks(docs(spark, d), B).select("volume_id", "seq", F.col("length").cast("long").alias("length"))
    for part in ("seq < 3", "seq >= 3"):
        frames.where(part).write.mode("append").parquet(f"{top}/frames")
        out = W.appended(W.syncs(W.frames_stream(spark, f"{top}/frames", "volume_id long, seq long, length long"), 2500), top, "syncs")
    return out


@query(f"WITH {_PAIR}, s AS (SELECT source, digest FROM m), n AS (SELECT d.source, e.digest FROM e JOIN documents AS d ON d.doc_id = e.volume_id) SELECT a.source, a.n_chunks, a.n_distinct, (SELECT count(DISTINCT digest) FROM s AS x WHERE x.source IS NOT DISTINCT FROM a.source AND x.digest IN (SELECT digest FROM n WHERE n.source IS NOT DISTINCT FROM a.source)) AS n_kept FROM (SELECT source, count(*) AS n_chunks, count(DISTINCT digest) AS n_distinct FROM s GROUP BY source) AS a")
def sketch_dedup(spark, d):
    """Different chunks of each source, and those that an edit has left, from sketches of volumes that were merged; exact, as sources are cut into parts by digest, each of which a sketch holds whole."""
    sizes = [v.groupBy("source").agg(F.sum(F.ceil(F.octet_length("data") / B)).alias("n")).agg(F.max("n")).first()[0] for v in (docs(spark, d, "source"), edited(spark, d))]
    parts = N.parts_for(max(n or 0 for n in sizes), lg=14)
    cut = lambda v: M.build(v, B, "source").withColumn("part", N.part_of(F.col("digest"), parts))
    by = lambda v: N.merged(N.build(cut(v), ["volume_id", "source", "part"], lg=14), ["source", "part"], lg=14)
    old, new = by(docs(spark, d, "source")), by(edited(spark, d)).select(F.col("source").alias("s_"), F.col("part").alias("p_"), F.col("sketch").alias("new"))
    both = old.join(new, old["source"].eqNullSafe(new["s_"]) & (F.col("part") == F.col("p_")), "left")
    kept = F.coalesce(N.shared(F.col("sketch"), F.col("new")), F.lit(0).cast("long"))
    each = both.select("source", "n_chunks", N.distinct(F.col("sketch")).alias("n_distinct"), kept.alias("n_kept"))
    return each.groupBy("source").agg(*(F.sum(c).alias(c) for c in ("n_chunks", "n_distinct", "n_kept")))


@query(
    """SELECT n_nationkey AS log_id, CAST(n_nationkey % 2 AS INTEGER) AS version, problem, CASE WHEN problem IS NULL THEN coalesce(c, 0) ELSE 0 END AS n_ranges FROM (
    SELECT *, CASE WHEN n_nationkey % 5 = 1 THEN 'mac' WHEN n_nationkey % 5 = 2 THEN 'identity' END AS problem FROM nation) LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey"""
)
def log_upgrade(spark, d):
    """Logs of versions 0 and 1, of each nation's customers, opened after the upgrade: some with a changed header, or of another device."""
    n = F.col("n_nationkey")
    body = F.aggregate(F.array_sort(F.collect_list(F.col("c_custkey").cast("long"))), F.lit(b"").cast("binary"), lambda a, k: F.concat(a, X.number_bytes(k * 100, 8), X.number_bytes(k * 100 + 50, 8)))
    bodies = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(body.alias("body"))
    field = lambda x: F.unhex(F.rpad(F.hex(x.cast("binary")), 128, "0"))
    head = F.concat(F.when(n % 2 == 1, X.number_bytes(F.lit(1), 8)).otherwise(F.lit(b"")), X.number_bytes(n * 1000 + 4096, 8), X.number_bytes(F.lit(3), 8), field(F.col("n_name")))
    mac = F.when(n % 5 == 1, F.unhex(sha(F.lit(b"other")))).otherwise(F.unhex(sha(head)))
    rows = table(spark, d, "nation").join(bodies, "n_nationkey", "left").withColumn("data", F.concat(head, mac, F.coalesce("body", F.lit(b"")), F.lit(b"torn")))
    dev = F.struct((n * 1000 + 4096).cast("long").alias("size_bytes"), F.when(n % 5 == 2, 4).otherwise(3).cast("long").alias("epoch"), F.lit("kernel").alias("kernel_uuid"), F.lit("").alias("gpt_uuid"), F.lit("01020304").alias("mbr_signature"), F.col("n_name").alias("fs_uuid"), F.lit(8).cast("long").alias("major"), n.cast("long").alias("minor"))
    devices = rows.select(n.alias("log_id"), dev.alias("device"))
    new = X.upgraded(rows.select(n.alias("log_id"), "data"), devices)
    opened = X.open_log(new.where("problem is null").select("log_id", "data"), devices).select("log_id", F.col("n_ranges").alias("n"))
    return new.join(opened, "log_id", "left").select("log_id", F.col("version").cast("int").alias("version"), "problem", F.coalesce("n", F.lit(0).cast("long")).alias("n_ranges"))


_SESSION = f"""{_BLOCKS}, t AS (SELECT volume_id, off, digest, sha256(array_slice(encode(replace(text, 'a', 'o')), off + 1, off + {B})) AS new FROM m JOIN documents ON doc_id = volume_id),
v AS (SELECT volume_id, count_if(digest <> new) AS n, sha256(string_agg(digest, '' ORDER BY off)) AS was, sha256(string_agg(new, '' ORDER BY off)) AS now FROM t GROUP BY volume_id)"""


@query(f"WITH {_SESSION}, p AS (SELECT *, volume_id % 7 = 0 AND n > 0 AS missing FROM v) SELECT volume_id, CASE WHEN missing THEN 'missing' WHEN volume_id % 5 = 0 THEN 'final' END AS problem, CASE WHEN missing THEN 0 ELSE n END AS n_deltas, CASE WHEN missing THEN was ELSE now END AS digest FROM p")
def delta_sessions(spark, d):
    """Each volume gets the blocks of an edit as a session; some send no identity, some a last digest that is wrong."""
    t = table(spark, d, "documents").where("octet_length(text) > 0")
    vol = t.select(F.col("doc_id").cast("long").alias("volume_id"), F.col("text").cast("binary").alias("data"))
    new = t.select(F.col("doc_id").cast("long").alias("volume_id"), F.replace("text", F.lit("a"), F.lit("o")).cast("binary").alias("data"))
    v = F.col("volume_id")
    ident = F.struct(*(F.lit(8 if f in ("major", "minor") else 1).cast("long").alias(f) if f in ("size_bytes", "major", "minor", "epoch") else F.concat(F.lit(f), v.cast("string")).alias(f) for f in Q.FIELDS))
    none = F.lit(None)
    devices = vol.select("volume_id", F.octet_length("data").cast("long").alias("size"), ident.alias("device"))
    old = M.blocks(vol, B).select("volume_id", "offset", "data")
    both = t.select(F.col("doc_id").cast("long").alias("volume_id"), F.col("text").cast("binary").alias("data"), F.replace("text", F.lit("a"), F.lit("o")).cast("binary").alias("after"))
    piece = F.substr("after", (F.col("offset") + 1).cast("int"), F.lit(B))
    changed = M.blocks(both, B).withColumn("new", piece).where("new <> data")  # the edit keeps lengths, so both are cut in one scan
    kind_of = devices.schema["device"].dataType
    first = devices.where("volume_id % 7 <> 0").select("volume_id", F.lit(0).cast("long").alias("seq"), F.lit("I").alias("kind"), F.col("device").alias("identity"), none.cast("long").alias("offset"), none.cast("binary").alias("data"), none.cast("string").alias("digest"))
    deltas = changed.select("volume_id", (F.col("seq") + 1).alias("seq"), F.lit("D"), none.cast(kind_of), "offset", F.col("new"), none.cast("string"))
    root = M.digest_of_digests(M.build(new, B), ["volume_id"])
    last = root.select("volume_id", F.lit(1 << 40).cast("long"), F.lit("G"), none.cast(kind_of), none.cast("long"), none.cast("binary"), F.when(v % 5 == 0, F.repeat(F.lit("0"), 64)).otherwise(F.col("root")))
    judged = Q.judged(first.union(deltas).union(last), devices)
    return Q.outcome(judged, Q.written(old, judged, B))


@query(
    """WITH RECURSIVE f AS MATERIALIZED (SELECT user_id, event_id, event_id % 7 * 100 AS n, event_id * 60 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    w AS (SELECT user_id, event_id, rn, n AS held, sec AS last, sec, n >= 1500 AS due FROM f WHERE rn = 1
          UNION ALL
          SELECT f.user_id, f.event_id, f.rn, CASE WHEN due THEN 0 ELSE held END + f.n, CASE WHEN due THEN w.sec ELSE last END, f.sec, CASE WHEN due THEN 0 ELSE held END + f.n >= 1500 OR f.sec - CASE WHEN due THEN w.sec ELSE last END >= 30000
          FROM w JOIN f ON f.user_id = w.user_id AND f.rn = w.rn + 1)
    SELECT user_id, event_id FROM w WHERE due"""
)
def checkpoint_times(spark, d):
    """Events at which a checkpoint is written, after so many bytes or seconds, whichever comes first."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 7 * 100).alias("length"), (F.col("event_id") * 60).alias("at"))
    return resume.checkpoints(e, ["user_id"], "event_id", 1500, "at", 30_000).select("user_id", "event_id")
