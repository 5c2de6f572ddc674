"""Delta sessions by a loop over bytes; old logs."""

import hashlib
import random

from pyspark.sql import functions as F

from blockweave.operators import session as Q
from blockweave.sources import records as X

SIZE = 64
ID = "struct<size_bytes:long,kernel_uuid:string,gpt_uuid:string,mbr_signature:string,fs_uuid:string,major:int,minor:int,epoch:long>"
FRAMES = f"volume_id long, seq long, kind string, identity {ID}, offset long, data binary, digest string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def digest(vol):
    return sha("".join(sha(bytes(vol[i : i + SIZE])) for i in range(0, len(vol), SIZE)).encode())


def plain(frames, vol, ident):
    """(problem, deltas, volume) of one session, a frame at a time."""
    known, said, n = False, None, 0
    for _, _, kind, got, off, data, dig in sorted(frames, key=lambda f: f[1]):
        if kind == "I":
            if got != ident:
                return "identity", n, vol
            known = True
        elif kind == "D":
            if not known:
                return "missing", n, vol
            if off is None or data is None:
                return "offset", n, vol
            if off < 0 or off + len(data) > len(vol):
                return "bounds", n, vol
            vol = vol[:off] + data + vol[off + len(data) :]
            n += 1
        elif kind == "G":
            if dig is None or len(dig) != 64:
                return "digest", n, vol
            said = dig
        elif kind != "S":
            return "kind", n, vol
    return ("final" if said is not None and said != digest(vol) else None), n, vol


def test_sessions_by_a_loop(spark):
    r = random.Random(3)
    vols = {v: r.randbytes(r.randrange(1, 400)) for v in range(30)}
    ident = {v: (len(b), "k", "", None, f"fs{v}", 8, v, 1) for v, b in vols.items()}
    frames = []
    for v, b in vols.items():
        mine = [] if v % 7 == 0 else [(v, 0, "I", ident[v] if v % 7 != 1 else (*ident[v][:-1], 2), None, None, None)]
        mine.append((v, 1, "S", None, None, b"", None))
        for s in range(2, 2 + r.randrange(9)):
            n = r.randrange(0, min(len(b), 150) + 1)
            off = r.randrange(0, len(b) - n + 1) if r.random() < 0.95 else r.choice([-1, len(b) - n + 1, None, 2**63 - 1])
            mine.append((v, s, "D", None, off, r.randbytes(n), None))
        if v % 5 != 2:
            _, _, end = plain(mine, b, ident[v])
            mine.append((v, 90, "G", None, None, None, digest(end) if v % 5 else r.choice(["0" * 64, "short"])))
        if v == 11:
            mine.append((v, 95, "?", None, None, None, None))
        frames += mine
    r.shuffle(frames)
    devices = spark.createDataFrame([(v, len(b), ident[v]) for v, b in vols.items()], f"volume_id long, size long, device {ID}")
    blocks = spark.createDataFrame([(v, i, b[i : i + SIZE]) for v, b in vols.items() for i in range(0, len(b), SIZE)], "volume_id long, offset long, data binary")
    judged = Q.judged(spark.createDataFrame(frames, FRAMES).repartition(3), devices)
    after = Q.written(blocks, judged, SIZE)
    want = {v: plain([f for f in frames if f[0] == v], b, ident[v]) for v, b in vols.items()}
    got = {}
    for x in sorted(after.collect()):
        got[x.volume_id] = got.get(x.volume_id, b"") + bytes(x.data)
    assert got == {v: w[2] for v, w in want.items()}
    ends = {x.volume_id: (x.problem, x.n_deltas, x.digest) for x in Q.outcome(judged, after).collect()}
    assert ends == {v: (p, n, digest(b)) for v, (p, n, b) in want.items()}
    assert {p for p, _, _ in want.values()} >= {None, "identity", "missing", "bounds", "final"}
    stray = Q.judged(spark.createDataFrame([(99, 0, "I", None, None, None, None), (98, 0, None, None, None, None, None)], FRAMES), devices)
    assert {x.volume_id: (x.problem, x.live) for x in stray.collect()} == {99: ("device", False), 98: ("kind", False)}
    none = Q.judged(spark.createDataFrame([], FRAMES), devices)
    assert none.count() == 0 and Q.outcome(none, Q.written(blocks, none, SIZE)).count() == 0


def old_log(version, size, epoch, fs, ranges, tail=b"", spoil=False):
    le = lambda x: x.to_bytes(8, "little")
    head = (le(1) if version else b"") + le(size) + le(epoch) + fs.encode().ljust(64, b"\x00")
    return head + hashlib.sha256(head + b"!" * spoil).digest() + b"".join(le(a) + le(b) for a, b in ranges) + tail


def test_old_logs_are_upgraded(spark):
    ranges = [(0, 4096), (8192, 2**40)]
    files = [(v * 10 + i, old_log(v, 5000 + (i == 3), 7, "fs" if i != 4 else "other", ranges[: 2 - (i == 1)], b"torn" * (i == 2), i == 5)) for v in (0, 1) for i in range(6)]
    files += [(50, b""), (51, b"short"), (52, old_log(1, 5000, 7, "fs", [])[:100])]
    device = (5000, 7, "kernel", "gpt", "01020304", "fs", 8, 1)
    names = "size_bytes:long,epoch:long,kernel_uuid:string,gpt_uuid:string,mbr_signature:string,fs_uuid:string,major:long,minor:long"
    logs = spark.createDataFrame(files, "log_id int, data binary")
    devices = spark.createDataFrame([(k, device) for k, _ in files], f"log_id int, device struct<{names}>")
    new = X.upgraded(logs, devices).cache()
    assert {r.log_id: (r.version, r.problem) for r in new.collect()} == {v * 10 + i: (v, {3: "identity", 4: "identity", 5: "mac"}.get(i)) for v in (0, 1) for i in range(6)} | {50: (None, None), 51: (None, "short"), 52: (None, "short")}
    good = new.where("problem is null").select("log_id", "data")
    opened = {r.log_id: (r.problem, r.n_ranges, r.torn) for r in X.open_log(good, devices).collect()}
    assert opened == {v * 10 + i: (None, 2 - (i == 1), 0) for v in (0, 1) for i in range(3)} | {50: (None, 0, 0)}
    back = {(r.log_id, r.pos): (r.start, r.end) for r in X.log_ranges(good).collect()}
    assert all(x == ranges[p] for (_, p), x in back.items()) and len(back) == 10
    again = X.upgraded(good, devices).where("problem is null")
    assert sorted((r.log_id, bytes(r.data)) for r in again.collect()) == sorted((r.log_id, bytes(r.data)) for r in good.collect())
    new.unpersist()
