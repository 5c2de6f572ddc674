"""BLAKE3 and MD4, many strings at a time.

BLAKE3 cuts a string into chunks of 1 KiB that are hashed by themselves and
joined in pairs, an odd one at the end waiting for the next level. So the chunks
of a batch are lanes of array operations, and parts of a volume that hold a power
of two of chunks are hashed by different tasks and joined by levels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1024
# The initial words, the order of message words for the next round, and the flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = np.array([2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8])
START, END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16
#: Nodes that one group joins, a power of two, and levels of groups: RUN ** LEVELS parts at most.
RUN, LEVELS = 1024, 4
#: Chunks hashed at once.
LANES = 4096
_DIAGONAL = [np.roll(np.arange(4), -i) for i in range(4)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(a, b, c, d, x, y):
    a = a + b + x
    d = _turn(d ^ a, 16)
    c = c + d
    b = _turn(b ^ c, 12)
    a = a + b + y
    d = _turn(d ^ a, 8)
    c = c + d
    return a, _turn(b ^ c, 7), c, d


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8, lanes) from (8, lanes), message words (16, lanes), and per lane counter, bytes and flags. The four mixings of a half round are one array operation."""
    lanes = cv.shape[1]
    a, b, c = cv[:4].copy(), cv[4:].copy(), np.repeat(IV[:4, None], lanes, 1)
    d = np.stack([counter & 0xFFFFFFFF, counter >> 32, size, flags]).astype(np.uint32)
    for r in range(7):
        a, b, c, d = _mix(a, b, c, d, words[0:8:2], words[1:8:2])
        b, c, d = b[_DIAGONAL[1]], c[_DIAGONAL[2]], d[_DIAGONAL[3]]
        a, b, c, d = _mix(a, b, c, d, words[8::2], words[9::2])
        b, c, d = b[_DIAGONAL[3]], c[_DIAGONAL[2]], d[_DIAGONAL[1]]
        if r < 6:
            words = words[ORDER]
    return np.concatenate([a ^ c, b ^ d])


def _key(key: bytes | None) -> tuple[np.ndarray, int]:
    """Key words and flag; a key is filled up with zeros, or cut, to 32 bytes."""
    return (IV, 0) if key is None else (np.frombuffer(key[:32].ljust(32, b"\x00"), "<u4").astype(np.uint32), KEYED)


def _chunks(pieces: list[bytes], counters: np.ndarray, roots: np.ndarray, key: bytes | None) -> np.ndarray:
    """Chaining values (8, lanes) of chunks of 0 to 1024 bytes each; roots: which are a string's only chunk."""
    words, flag = _key(key)
    lens = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(CHUNK, b"\x00") for p in pieces), "<u4").reshape(len(pieces), 16, 16)
    last = np.maximum(0, (lens - 1) // 64)
    cv = np.repeat(words[:, None], len(pieces), 1)
    for k in range(int(last.max(initial=-1)) + 1):
        on = np.flatnonzero(last >= k)
        end = last[on] == k
        flags = flag + START * (k == 0) + END * end + ROOT * (end & roots[on])
        cv[:, on] = compress(cv[:, on], raw[on, k].T.astype(np.uint32), counters[on], np.minimum(64, lens[on] - 64 * k), flags)
    return cv


def _joined(nodes: list[np.ndarray], key: bytes | None, root: bool) -> np.ndarray:
    """One chaining value (8,) for each list of nodes (8, n): joined in pairs, an odd last one kept for the next level. All lists' pairs of a level are joined at once."""
    words, flag = _key(key)
    nodes = list(nodes)
    while live := [i for i, v in enumerate(nodes) if v.shape[1] > 1]:
        pairs = [nodes[i][:, : nodes[i].shape[1] // 2 * 2] for i in live]
        both = np.concatenate(pairs, axis=1)
        left, right = both[:, 0::2], both[:, 1::2]
        counts = [p.shape[1] // 2 for p in pairs]
        top = np.repeat([root and nodes[i].shape[1] == 2 for i in live], counts)
        n = left.shape[1]
        up = compress(np.repeat(words[:, None], n, 1), np.concatenate([left, right]), np.zeros(n, np.int64), np.full(n, 64), flag + PARENT + ROOT * top)
        for i, part in zip(live, np.split(up, np.cumsum(counts)[:-1], axis=1), strict=True):
            nodes[i] = np.concatenate([part, nodes[i][:, nodes[i].shape[1] // 2 * 2 :]], axis=1)
    return np.stack([v[:, 0] for v in nodes], axis=1) if nodes else np.zeros((8, 0), np.uint32)


def _text(cv: np.ndarray) -> list[bytes]:
    return [c.astype("<u4").tobytes() for c in cv.T]


def nodes_many(blobs: list[bytes], key: bytes | None = None, first: np.ndarray | None = None) -> tuple[list[bytes], list[bytes]]:
    """(chaining value, digest as if it were a whole string) of each blob; first: number of a blob's first chunk in its volume. At most LANES chunks are hashed at once."""
    first = np.zeros(len(blobs), np.int64) if first is None else first
    nodes, single = [], []
    owner = [(i, j) for i, b in enumerate(blobs) for j in range(max(1, -(-len(b) // CHUNK)))]
    parts: list[list[np.ndarray]] = [[] for _ in blobs]
    for lo in range(0, len(owner), LANES):
        some = owner[lo : lo + LANES]
        pieces = [bytes(blobs[i][j * CHUNK : (j + 1) * CHUNK]) for i, j in some]
        got = _chunks(pieces, np.array([first[i] + j for i, j in some], np.int64), np.zeros(len(some), bool), key)
        at = 0
        while at < len(some):
            i = some[at][0]
            n = min(len(some) - at, max(1, -(-len(blobs[i]) // CHUNK)) - some[at][1])
            parts[i].append(got[:, at : at + n])
            at += n
    nodes = [np.concatenate(p, axis=1) for p in parts]
    cvs, wholes = _joined(nodes, key, False), _joined(nodes, key, True)
    single = [i for i, v in enumerate(nodes) if v.shape[1] == 1]
    if single:
        wholes[:, single] = _chunks([bytes(blobs[i]) for i in single], np.zeros(len(single), np.int64), np.ones(len(single), bool), key)
    return _text(cvs), _text(wholes)


def blake3_many(blobs: list[bytes], key: bytes | None = None) -> list[bytes]:
    return nodes_many(blobs, key)[1]


def blake3(data: Column, key: bytes | None = None) -> Column:
    """BLAKE3 of a binary column as lowercase hex, keyed if there is a key; null of null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        there = s.notna().to_numpy()
        out = np.full(len(s), None, object)
        out[there] = [d.hex() for d in blake3_many(s[there].tolist(), key)]
        return pd.Series(out)

    return run(data)


def blake3_of_parts(parts: DataFrame, by: list[str], size: int, key: bytes | None = None) -> DataFrame:
    """(by, size, blake3) of volumes in parts (by, start, data): each part is hashed where it lies, 64 bytes of it are shuffled, and nodes are joined by levels in groups of RUN.

    All parts but a volume's last have ``size`` bytes, a power of two from 1 KiB;
    they begin at whole multiples of it. Where parts are missing, doubled or cut
    otherwise, the digest is null. A volume with an empty part alone has the digest
    of no bytes; a null part counts as one without bytes.
    """
    if size < CHUNK or size & (size - 1):
        raise ValueError(f"parts must have a power of two of bytes, {CHUNK} at least, not {size}")
    rows = parts.select(*by, F.col("start").cast("long").alias("start"), F.coalesce("data", F.lit(b"")).alias("data"))
    width = len(by)
    schema = T.StructType([*rows.schema.fields[:width], *T.StructType.fromDDL("start long, n_ long, cv_ binary, root_ binary").fields])
    names = schema.names

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                start = part.column(width).to_numpy(zero_copy_only=False).astype(np.int64)
                blobs = [x.as_buffer() for x in part.column(width + 1)]
                blobs = [memoryview(x) for x in blobs]
                cv, root = nodes_many(blobs, key, start // CHUNK)
                yield pa.RecordBatch.from_arrays([*part.columns[: width + 1], pa.array([len(x) for x in blobs], pa.int64()), pa.array(cv, pa.binary()), pa.array(root, pa.binary())], names=names)

    nodes = rows.mapInArrow(run, schema).withColumn("i_", F.floor(F.col("start") / size)).withColumn("ok_", F.col("start") % size == 0)
    nodes = nodes.withColumn("end_", F.col("start") + F.col("n_"))

    @F.pandas_udf(T.StructType.fromDDL("cv binary, root binary"))
    def join(cvs: pd.Series) -> pd.DataFrame:
        lists = [np.stack([np.frombuffer(c, "<u4").astype(np.uint32) for c in x], axis=1) for x in cvs]
        return pd.DataFrame({"cv": _text(_joined(lists, key, False)), "root": _text(_joined(lists, key, True))})

    nodes = nodes.select(*by, "i_", "cv_", "root_", "ok_", F.col("n_").alias("bytes_"), "end_", F.lit(1).cast("long").alias("parts_"))
    for _ in range(LEVELS):
        up = nodes.groupBy(*by, F.floor(F.col("i_") / RUN).alias("up_")).agg(F.array_sort(F.collect_list(F.struct("i_", "cv_"))).alias("all_"), F.min("root_").alias("root_"), F.bool_and("ok_").alias("ok_"), F.sum("bytes_").alias("bytes_"), F.max("end_").alias("end_"), F.sum("parts_").alias("parts_"))
        up = up.withColumn("j_", join(F.transform("all_", lambda x: x["cv_"])))
        alone = F.size("all_") == 1
        nodes = up.select(*by, F.col("up_").alias("i_"), F.when(alone, F.col("all_")[0]["cv_"]).otherwise(F.col("j_.cv")).alias("cv_"), F.when(alone, F.col("root_")).otherwise(F.col("j_.root")).alias("root_"), "ok_", "bytes_", "end_", "parts_")
    whole = F.col("ok_") & (F.col("i_") == 0) & (F.col("bytes_") == F.col("end_")) & (F.col("parts_") == F.greatest(F.lit(1), F.ceil(F.col("end_") / size)))
    return nodes.select(*by, F.col("end_").alias("size"), F.when(whole, F.lower(F.hex("root_"))).alias("blake3"))


def md4_many(blobs: list[bytes]) -> list[bytes]:
    """MD4 of all blobs, one array step for the next 64 bytes of each; those that have ended wait."""
    state = np.repeat(np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)[:, None], len(blobs), 1)
    padded = [bytes(b) + b"\x80" + b"\x00" * ((55 - len(b)) % 64) + (8 * len(b) % (1 << 64)).to_bytes(8, "little") for b in blobs]
    n = np.array([len(p) // 64 for p in padded], np.int64)
    flat, start = np.frombuffer(b"".join(padded), "<u4").reshape(-1, 16), np.cumsum(n) - n
    # Of each round the order of words, the turns and the constant.
    rounds = (
        (lambda x, y, z: (x & y) | (~x & z), list(range(16)), (3, 7, 11, 19), 0),
        (lambda x, y, z: (x & y) | (x & z) | (y & z), [4 * (i % 4) + i // 4 for i in range(16)], (3, 5, 9, 13), 0x5A827999),
        (lambda x, y, z: x ^ y ^ z, [0, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15], (3, 9, 11, 15), 0x6ED9EBA1),
    )
    for k in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > k)
        words = flat[start[on] + k].T.astype(np.uint32)
        s = [state[j, on] for j in range(4)]
        before = [x.copy() for x in s]
        for mix, order, turns, add in rounds:
            for i, w in enumerate(order):
                j = -i % 4
                v = s[j] + mix(s[(j + 1) % 4], s[(j + 2) % 4], s[(j + 3) % 4]) + words[w] + np.uint32(add)
                s[j] = _turn(v, 32 - turns[i % 4])
        for j in range(4):
            state[j, on] = s[j] + before[j]
    return [c.astype("<u4").tobytes() for c in state.T]


@F.pandas_udf(T.StringType())
def md4(data: pd.Series) -> pd.Series:
    """MD4 of a binary column as lowercase hex; null of null."""
    there = data.notna().to_numpy()
    out = np.full(len(data), None, object)
    out[there] = [d.hex() for d in md4_many(data[there].tolist())]
    return pd.Series(out)
