"""Spark data sources for volumes and change tables as files.

``volume`` reads device images of any size, a byte range for each task, and reads
and writes volume stores: folders of Arrow files with a list that is switched
last, so that a write is seen whole or not at all. ``changes`` reads change tables
by ranges of records. Paths are any that pyarrow's file systems open, on storage
that the driver and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a block, of a task's share, and of one Arrow batch.
BLOCK, PARTITION, BATCH = 1 << 20, 1 << 26, 1 << 23
LIST = "_volume.json"
ROW = pa.schema([("volume", pa.string()), ("offset", pa.int64()), ("length", pa.int32()), ("data", pa.binary())])
RECORD = pa.schema([("log", pa.string()), ("chunk_size", pa.int64()), ("pos", pa.int64()), ("a", pa.decimal128(20, 0)), ("b", pa.decimal128(20, 0))])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI; Spark's file:/x is a URI too."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Share(InputPartition):
    """Bytes of one image, or Arrow batches of one file of a store, from start to end."""

    path: str
    start: int
    end: int
    stored: bool = False


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has written: its name in the store, batches, and the least and greatest offset."""

    name: str
    batches: list[tuple[int, int, int]]


class VolumeSource(DataSource):
    """Options: path; block, partition: bytes of a row and of a task's share; start, end: bytes outside of which whole shares, or batches of a store, are not read.

    The bounds are options and not pushed filters, as Spark keeps a source's
    pushed filters for later scans of the same DataFrame.
    """

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "volume string, offset long, length int, data binary"

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        names = [f.name for f in schema.fields]
        if names != ROW.names:
            raise ValueError(f"a volume store has the columns {ROW.names}, not {names}")
        return VolumeWriter(self.options, overwrite)


def _sizes(options) -> tuple[str, int, int]:
    block, share = int(options.get("block", BLOCK)), int(options.get("partition", PARTITION))
    if block <= 0 or share < block or share % block:
        raise ValueError("partition must be a whole number of blocks, which must have some bytes")
    if "path" not in options:
        raise ValueError("a path is needed")
    return options["path"], block, share


class VolumeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block, self.share = _sizes(options)
        self.least, self.most = int(options.get("start", 0)), int(options.get("end", 1 << 63))

    def partitions(self) -> list[Share]:
        store, at = store_of(self.path)
        if store.get_file_info(f"{at}/{LIST}").type == fs.FileType.File:
            return self._stored(store, at)
        out = []
        for f in _files(self.path):
            for lo in range(0, f.size, self.share):
                hi = min(f.size, lo + self.share)
                if hi > self.least and lo < self.most:
                    out.append(Share(f.path, lo, hi))
        return out

    def _stored(self, store, at: str) -> list[Share]:
        out = []
        for f in json.loads(store.open_input_file(f"{at}/{LIST}").read())["files"]:
            held, first = 0, 0
            for i, (size, least, most) in enumerate([*f["batches"], (self.share, 0, -1)]):
                end = i == len(f["batches"])
                wanted = not end and most >= self.least and least < self.most
                if (held and (held + size > self.share or not wanted)) or end:
                    if held:
                        out.append(Share(f"{at}/{f['name']}", first, i, True))
                    held = 0
                if wanted:
                    first = i if not held else first
                    held += max(1, size)
        return out

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        if share is None:  # no shares at all
            return
        store, _ = store_of(self.path)
        if share.stored:
            with store.open_input_file(share.path) as raw, pa.ipc.open_file(raw) as f:
                for i in range(share.start, share.end):
                    yield f.get_batch(i)
            return
        name = share.path.rsplit("/", 1)[-1]
        with store.open_input_file(share.path) as f:
            step = max(1, BATCH // self.block) * self.block
            for lo in range(share.start, share.end, step):
                raw = f.read_at(min(step, share.end - lo), lo)
                if len(raw) != min(step, share.end - lo):
                    raise OSError(f"{share.path} is shorter than it was")
                at = np.arange(0, len(raw), self.block)
                ends = np.append(at, len(raw)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(lo + at), pa.array(np.diff(ends)), data], schema=ROW)


class VolumeWriter(DataSourceArrowWriter):
    """Each task writes one file into the job's own folder; the list of files is replaced by a rename, after which nothing can fail that a reader sees."""

    def __init__(self, options, overwrite: bool):
        self.path, _, _ = _sizes(options)
        self.overwrite, self.job = overwrite, f"_{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, at = store_of(self.path)
        name, sizes = f"{self.job}/{uuid.uuid4().hex}.arrow", []
        out = sink = None
        for b in batches:
            b = b.cast(ROW) if b.schema != ROW else b
            self._checked(b)
            if b.num_rows and out is None:
                store.create_dir(f"{at}/{self.job}", recursive=True)
                sink = store.open_output_stream(f"{at}/{name}")
                out = pa.ipc.new_file(sink, ROW)
            rows = max(1, b.num_rows * BATCH // max(1, b.nbytes))
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                offsets = part.column(1).to_numpy()
                out.write_batch(part)
                sizes.append((part.nbytes, int(offsets.min()), int(offsets.max())))
        if out is None:
            return Written("", [])
        out.close()
        sink.close()
        return Written(name, sizes)

    @staticmethod
    def _checked(b: pa.RecordBatch) -> None:
        if b.column(0).null_count or b.column(1).null_count or b.column(3).null_count:
            raise ValueError("a block needs a volume, an offset and bytes")
        length = pa.compute.binary_length(b.column(3))
        if b.num_rows and (pa.compute.min(b.column(1)).as_py() < 0 or not pa.compute.all(pa.compute.equal(length, pa.compute.fill_null(b.column(2), -1))).as_py()):
            raise ValueError("a block needs an offset from 0 and as many bytes as it says")

    def commit(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        current = f"{at}/{LIST}"
        old = json.loads(store.open_input_file(current).read())["files"] if store.get_file_info(current).type == fs.FileType.File else []
        new = [{"name": m.name, "batches": m.batches} for m in messages if m is not None and m.name]
        if new:  # what attempts that failed have left
            kept = {m["name"].rsplit("/", 1)[-1] for m in new}
            for f in store.get_file_info(fs.FileSelector(f"{at}/{self.job}")):
                if f.base_name not in kept:
                    store.delete_file(f.path)
        with store.open_output_stream(f"{at}/{LIST}{self.job}") as out:
            out.write(json.dumps({"files": new if self.overwrite else old + new}).encode())
        store.move(f"{at}/{LIST}{self.job}", current)
        if self.overwrite:
            for folder in {f["name"].split("/")[0] for f in old}:
                store.delete_dir(f"{at}/{folder}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        for name in (f"{at}/{self.job}", f"{at}/{LIST}{self.job}"):
            kind = store.get_file_info(name).type
            if kind == fs.FileType.Directory:
                store.delete_dir(name)
            elif kind == fs.FileType.File:
                store.delete_file(name)
        if store.get_file_info(at).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(at)):
            store.delete_dir(at)


class ChangeSource(DataSource):
    """Options: path of change tables; partition: bytes of a task's share of records."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return "log string, chunk_size long, pos long, a decimal(20,0), b decimal(20,0)"

    def reader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


class ChangeReader(DataSourceReader):
    """All whole records after the header chunk; a table whose header can't stand is an error."""

    def __init__(self, options):
        self.path, _, share = _sizes({"block": "16", **options})
        self.share = share

    @staticmethod
    def header(raw: bytes, path: str) -> int:
        # Magic number, mark of a valid table, version; the chunk's size follows in sectors.
        if len(raw) < 16 or raw[:12] != (0x70416E53).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2:
            raise ValueError(f"{path} has no header of a change table")
        if not (size := int.from_bytes(raw[12:16], "little") * 512):
            raise ValueError(f"{path} has chunks of no bytes")
        return size

    def partitions(self) -> list[Share]:
        store, _ = store_of(self.path)
        out = []
        for f in _files(self.path):
            with store.open_input_file(f.path) as raw:
                skip = self.header(raw.read_at(16, 0), f.path)
            whole = skip + max(0, f.size - skip) // 16 * 16
            out += [Share(f.path, lo, min(whole, lo + self.share)) for lo in range(skip, whole, self.share)]
        return out

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        if share is None:  # no shares at all
            return
        store, _ = store_of(self.path)
        name = share.path.rsplit("/", 1)[-1]
        with store.open_input_file(share.path) as f:
            skip = self.header(f.read_at(16, 0), share.path)
            for lo in range(share.start, share.end, 1 << 16):
                raw = np.frombuffer(f.read_at(min(1 << 16, share.end - lo), lo), "<u8").reshape(-1, 2)
                numbers = lambda c, raw=raw: pa.array([Decimal(x) for x in raw[:, c].tolist()], pa.decimal128(20, 0))
                pos = (lo - skip) // 16 + np.arange(len(raw))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(raw)), pa.array(np.full(len(raw), skip)), pa.array(pos), numbers(0), numbers(1)], schema=RECORD)


def register(spark: SparkSession) -> SparkSession:
    """Make both sources known to the session."""
    spark.dataSource.register(VolumeSource)
    spark.dataSource.register(ChangeSource)
    return spark


def changed(records: DataFrame) -> DataFrame:
    """(log, pos, start, end, problem) of records of change tables: those before the first whose second number is 0, as byte ranges; problem as in ``records.change_records``."""
    stop = records.where("b = 0").groupBy("log").agg(F.min("pos").alias("stop"))
    live = records.join(stop, "log", "left").where("stop is null or pos < stop")
    most, size = F.lit(str(2**64 - 1)).cast("decimal(20,0)"), F.col("chunk_size").cast("decimal(20,0)")
    start = F.col("a") * size
    problem = F.when(start > most, "start").when(start + (size - 1) > most, "end")
    value = lambda c: F.when(problem.isNull(), c.cast("decimal(20,0)"))
    return live.select("log", "pos", value(start).alias("start"), value(start + size).alias("end"), problem.alias("problem"))
