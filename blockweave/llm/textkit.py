"""Vectorised word and shingle hashing over Arrow batches, and the shuffle helpers built on it.

Every operator of this subpackage that walks whole texts goes through
``each_chunk``: a partition's Arrow batches are cut into chunks of about one
megabyte of UTF-8 (a longer text is a chunk of its own), and numpy works on the
chunk's bytes at once. Memory is bounded by the chunk and the longest single
text, not by the partition.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; those separators are single
bytes in UTF-8 and never part of a longer sequence, so bytes suffice.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
FRAGMENT_BYTES = 1 << 25
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = U(0xD6E8FEB86659FD93)  # 3 mod 4: prefix sums of powers stay well mixed
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix((np.arange(256, dtype=U) + U(1)) * _ODD)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse; kept for the next chunk."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, CHUNK_BYTES + 4096), base, U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


class Chunk:
    """A few whole texts as one byte array, with lazily found words.

    ``ids`` is the Arrow slice of the rows' other columns; ``offs`` has the
    byte offset of each text (one more than rows).
    """

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        self.rows, self.data, self.offs, self.n = rows, data, offs, len(offs) - 1
        self._prefix = None

    def words(self) -> None:
        isw = ~_SPACE[self.data]
        start, end = isw.copy(), isw.copy()
        start[1:] &= ~isw[:-1]
        end[:-1] &= ~isw[1:]
        inner = self.offs[:-1][self.offs[:-1] < len(isw)]
        start[inner] = isw[inner]
        last = self.offs[1:][self.offs[1:] > 0] - 1
        end[last] = isw[last]
        self.ws, self.we = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.woff = np.searchsorted(self.ws, self.offs)
        self.n_words = np.diff(self.woff)
        self.wdoc = np.repeat(np.arange(self.n), self.n_words)

    def span_hash(self, s: np.ndarray, e: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Hash of each byte range: equal for equal bytes wherever they stand. table: value of each byte (for folding)."""
        p, inv = powers(len(self.data) + 1)
        if self._prefix is None or self._prefix[0] is not table:
            h = np.zeros(len(self.data) + 1, U)
            np.cumsum((_BYTE if table is None else table)[self.data] * p[:-1], out=h[1:])
            self._prefix = (table, h)
        h = self._prefix[1]
        return mix((h[e] - h[s]) * inv[s] + (e - s).astype(U) * _ODD)

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        return self.span_hash(self.ws, self.we, FOLDED if fold else None)

    def shingles(self, wh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position of the first word) of each run of k words inside one text."""
        at = np.flatnonzero(np.arange(len(wh)) + k <= self.woff[1:][self.wdoc]) if len(wh) else np.zeros(0, np.int64)
        if k <= 8:
            h = wh[at]
            for j in range(1, k):
                h = h * _BASE + wh[at + j]
        else:
            p, inv = powers(len(wh) + 1)
            run = np.zeros(len(wh) + 1, U)
            np.cumsum(wh * p[:-1], out=run[1:])
            h = (run[at + k] - run[at]) * inv[at]
        return mix(h + U(k * int(_ODD) % (1 << 64))), at

    def shingle_sets(self, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hashes sorted within each text and distinct, offsets by text); a text of fewer than k words is one shingle, without words none."""
        self.words()
        wh = self.word_hashes(fold)
        h, at = self.shingles(wh, k)
        doc = self.wdoc[at]
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
        if len(short):
            hs = np.zeros(len(short), U)
            for j in range(k - 1):
                has = self.n_words[short] > j
                hs[has] = hs[has] * _BASE + wh[self.woff[short[has]] + j]
            h = np.concatenate([h, mix(hs + self.n_words[short].astype(U) * _ODD)])
            doc = np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[keep], np.searchsorted(doc[keep], np.arange(self.n + 1))

    def char_starts(self) -> np.ndarray:
        """True where a code point begins."""
        return (self.data & 0xC0) != 0x80


FOLDED = _BYTE.copy()
FOLDED[65:91] = _BYTE[97:123]


def each_chunk(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(pc.cast(batch.column(batch.schema.get_field_index(text)), pa.large_string()), "")
        bufs = col.buffers()
        offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
            yield Chunk(batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            lo = hi


def over_chunks(df: DataFrame, fn: Callable[[Chunk], Iterator[dict]], schema: str, text: str = "text") -> DataFrame:
    """Map fn over df's chunks; fn yields dicts of equally long columns."""
    arrow = arrow_schema(schema)

    def run(batches):
        for chunk in each_chunk(batches, text):
            for cols in fn(chunk):
                yield record(cols, arrow)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def record(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def bound_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Arrow batches of this session end after so many bytes, so that very long texts don't pile up. A bound that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "-1", "9223372036854775807", str((1 << 31) - 1)):
        spark.conf.set(key, str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it. Where it is unset, a folder of our own in local mode; elsewhere that is an error, as each host has its own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if top is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(top)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder, so that lost executors cost no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: for wide or repetitive rows, which it holds in less room than a checkpoint. Tables go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_written() -> None:
    for spark, path in _written:
        drop(spark, path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fragments(spark: SparkSession, size: int) -> int:
    """How many fragments a table of so many bytes is cut into: four for each shuffle partition, and as many more as keep one below about FRAGMENT_BYTES, whatever the setting."""
    return max(4 * partitions(spark), -(-size // FRAGMENT_BYTES))


def pack(*cols: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned integers, each cut to its low so many bytes, one after the other."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w]).tobytes() for a, w in cols)


def unpack(blob, *widths: int) -> list[np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    n, out, at = len(raw) // sum(widths), [], 0
    for w in widths:
        a = np.zeros((n, 8), np.uint8)
        a[:, :w] = raw[at : at + n * w].reshape(n, w)
        out.append(a.view("<u8").ravel().astype(U, copy=False))
        at += n * w
    return out


def fragment_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the hash order each hash falls in."""
    return ((h >> U(40)) * U(n)) >> U(24)


def by_fragment(frag: np.ndarray, n: int, *cols: np.ndarray) -> Iterator[tuple]:
    """The columns cut by fragment, as (fragment, columns...)."""
    order = np.argsort(frag, kind="stable")
    ends = np.searchsorted(frag[order], np.arange(n + 1))
    cols = [c[order] for c in cols]
    for f in np.flatnonzero(np.diff(ends)):
        yield (int(f), *(c[ends[f] : ends[f + 1]] for c in cols))


def bitmap(keys: DataFrame, col: str, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits with one bit set for each 64-bit key: a filter without false negatives whose size is fixed, whatever the input.

    Built with Spark's bitmap aggregates; what comes to the driver is 2**bits / 8 bytes at most.
    """
    pos = F.shiftrightunsigned(F.col(col), 64 - bits)
    rows = keys.select(F.shiftrightunsigned(pos, 15).alias("b"), pos.bitwiseAND(32767).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for b, m in rows:
        out[b << 12 : (b << 12) + 4096][: len(m)] = np.frombuffer(m, np.uint8)[: len(out)]
    return out


def bitmap_table(keys: DataFrame, col: str, bits: int) -> DataFrame:
    """The same bitmap as a table (b_, m_) of 2**bits / 32768 rows of 4 KiB at most, to be broadcast by ``maybe_in``."""
    pos = F.shiftrightunsigned(F.col(col), 64 - bits)
    return settle(keys.select(F.shiftrightunsigned(pos, 15).alias("b_"), pos.bitwiseAND(32767).alias("p")).groupBy("b_").agg(F.bitmap_construct_agg("p").alias("m_")))


def maybe_in(df: DataFrame, col: str, table: DataFrame, bits: int, name: str) -> DataFrame:
    """df with the boolean ``name``: whether its 64-bit key may be one of the table's. No shuffle and no Python: the table's size is fixed, so it is broadcast."""
    pos = F.shiftrightunsigned(F.col(col), 64 - bits)
    p = pos.bitwiseAND(32767)
    byte = F.conv(F.hex(F.substr("m_", (F.shiftrightunsigned(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(by_, cast(p_ & 7 as int)) & 1 = 1")
    out = df.withColumn("b_", F.shiftrightunsigned(pos, 15)).join(F.broadcast(table), "b_", "left").withColumns({"by_": byte, "p_": p})
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("b_", "m_", "by_", "p_")


def packed(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs as doc_id, text and one struct own_ of all other columns, so that no name an operator uses can clash with them; and what selects docs' own columns again, as they were."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = F.struct(F.lit(0).alias("none"), F.col("doc_id").alias("id"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    back = [F.col("own_.id").alias(c) if c == "doc_id" else F.col(c) if c == "text" else F.col(f"own_.c{others.index(c)}").alias(c) for c in docs.columns]
    return docs.select("doc_id", "text", own.alias("own_")), back


def probe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    shift = 64 - (len(bits).bit_length() + 2)
    pos = keys >> U(shift)
    return (bits[(pos >> U(3)).astype(np.int64)] >> (pos & U(7)).astype(np.uint8)) & 1 > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def id_column(chunk: Chunk, name: str = "doc_id") -> pa.Array:
    return pc.cast(chunk.rows.column(chunk.rows.schema.get_field_index(name)), pa.int64())


def with_columns(df: DataFrame, fn: Callable[[Chunk], dict], schema: str, text: str = "text") -> DataFrame:
    """df with more columns, which fn makes from each chunk; a column of df of the same name gives way."""
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    df = df.drop(*(f.name for f in new if f.name in df.columns))
    full = StructType([*df.schema.fields, *new.fields])
    more, width = arrow_schema(schema), len(df.columns)

    def run(batches):
        for c in each_chunk(batches, text):
            got = record(fn(c), more)
            yield pa.RecordBatch.from_arrays([*c.rows.columns[:width], *got.columns], names=[*c.rows.schema.names, *more.names])

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, full)


def per_text(c: Chunk, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask has."""
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
    return run[c.offs[1:]] - run[c.offs[:-1]]


def with_text_kind(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, other columns as they are; a missing text column is an error."""
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
