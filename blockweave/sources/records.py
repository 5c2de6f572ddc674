"""Binary records as Columns: change tables, logs of applied ranges, partition signatures. All little-endian, decoded by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha
from ..functions.scalars import let

#: Bytes of a record of two numbers.
RECORD = 16
# Fields of a log's header, with their bytes; a digest of all that stands before it ends the header.
LOG_FIELDS = (("version", 8), ("size_bytes", 8), ("epoch", 8), ("kernel_uuid", 64), ("gpt_uuid", 64), ("mbr_signature", 8), ("fs_uuid", 64), ("major", 4), ("minor", 4))
LOG_VERSION = 2
LOG_HEADER = sum(n for _, n in LOG_FIELDS) + 32
_NUMBERS = ("version", "size_bytes", "epoch", "major", "minor")
#: What must be the same for a log to belong to a device.
LOG_IDENTITY = ("size_bytes", "epoch", "kernel_uuid", "gpt_uuid", "mbr_signature", "fs_uuid", "major", "minor")


def number(raw: Column, at, n: int) -> Column:
    """The unsigned number of n bytes at a position, from 0, as DECIMAL(20,0)."""
    at = at if isinstance(at, Column) else F.lit(at)
    digits = F.hex(F.substr(raw, (at + 1).cast("int"), F.lit(n)))
    return F.conv(F.concat(*(F.substr(digits, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(n)))), 16, 10).cast("decimal(20,0)")


def number_bytes(value: Column, n: int) -> Column:
    """A number of 0 to 2**64 - 1 in n bytes; of one that passes them, its low bytes."""
    return F.unhex(_number_digits(value, n))


def _number_digits(value: Column, n: int) -> Column:
    width = max(16, 2 * n)
    digits = F.lpad(F.conv(value.cast("decimal(20,0)").cast("string"), 10, 16), width, "0")
    return let(digits, lambda d: F.concat(*(F.substr(d, F.lit(width - 2 * i - 1), F.lit(2)) for i in range(n))))


def _records(files: DataFrame, key: str, skip: int) -> DataFrame:
    """(key, pos, a, b): whole records after the first bytes; what is left of a torn one is ignored."""
    n = lambda d: F.floor((F.octet_length(d) - skip) / RECORD)
    whole = lambda d: F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n(d), F.lit(0).cast("long"))), lambda x: x < n(d))
    record = lambda d: F.transform(whole(d), lambda x: F.substr(d, (F.lit(skip + 1) + x * RECORD).cast("int"), F.lit(RECORD)))
    # A row takes its own bytes along and not the file's, which each access to the column would copy too.
    rows = files.select(key, F.posexplode(let(F.col("data"), record)).alias("pos", "record"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), number(F.col("record"), 0, 8).alias("a"), number(F.col("record"), 8, 8).alias("b"))


def change_header(raw: Column) -> Column:
    """struct(chunk_size in bytes, problem) of a change table's first 16 bytes; problem is short, magic, valid, version or null."""
    magic, valid, version = (number(raw, i, 4) for i in (0, 4, 8))
    problem = F.when(F.octet_length(raw) < RECORD, "short").when(magic != 0x70416E53, "magic").when(valid != 1, "valid").when(version != 1, "version")
    return F.struct(F.when(problem.isNull(), number(raw, 12, 4).cast("long") * 512).alias("chunk_size"), problem.alias("problem"))


def change_records(files: DataFrame, chunk: int, key: str = "log_id") -> DataFrame:
    """(key, pos, start, end, problem) of change tables (key, data): the ranges, half-open, of the records after the header chunk and before the first whose second number is 0.

    problem: "start" or "end" where the range passes 2**64 - 1, else null; such a
    range has no start and end.
    """
    if chunk <= 0:
        raise ValueError(f"a chunk must have some bytes, not {chunk}")
    rows = _records(files, key, chunk)
    stop = rows.where("b = 0").groupBy(key).agg(F.min("pos").alias("stop"))
    live = rows.join(stop, key, "left").where("stop is null or pos < stop")
    most, size = F.lit(str(2**64 - 1)).cast("decimal(20,0)"), F.lit(chunk).cast("decimal(20,0)")
    start = F.col("a") * size
    problem = F.when(start > most, "start").when(start + (size - 1) > most, "end")
    value = lambda c: F.when(F.col("problem").isNull(), c.cast("decimal(20,0)"))
    live = live.withColumn("problem", problem)
    return live.select(key, "pos", value(start).alias("start"), value(start + size).alias("end"), "problem")


def log_bytes(header: Column, ranges: Column) -> Column:
    """A log: its header from a struct of LOG_FIELDS (without version), and an array of struct(start, end)."""
    fields = [number_bytes(F.lit(LOG_VERSION), 8)]
    for name, n in LOG_FIELDS[1:]:
        fields.append(number_bytes(header[name], n) if name in _NUMBERS else F.unhex(F.rpad(F.hex(header[name].cast("binary")), 2 * n, "0")))
    head = F.concat(*fields)
    body = F.unhex(F.array_join(F.transform(ranges, lambda r: F.concat(_number_digits(r["start"], 8), _number_digits(r["end"], 8))), ""))
    return F.when(~F.exists(ranges, lambda r: r["start"].isNull() | r["end"].isNull()), F.concat(head, F.unhex(sha(head)), body))


def log_header(raw: Column) -> Column:
    """struct(LOG_FIELDS..., problem) of a log: problem is short, version, mac or null."""
    at, out = 0, []
    for name, n in LOG_FIELDS:
        value = number(raw, at, n).cast("long") if name in _NUMBERS else F.rtrim(F.translate(F.decode(F.substring(raw, at + 1, n), "UTF-8"), "\x00", " "))
        out.append(value.alias(name))
        at += n
    short = F.octet_length(raw) < LOG_HEADER
    mac = F.lower(F.hex(F.substring(raw, at + 1, 32))) != sha(F.substring(raw, 1, at))
    return F.struct(*out, F.when(short, "short").when(number(raw, 0, 8) != LOG_VERSION, "version").when(mac, "mac").alias("problem"))


def log_ranges(files: DataFrame, key: str = "log_id") -> DataFrame:
    """(key, pos, start, end) of logs (key, data): the whole entries after the header; the torn tail that a crash can leave is cut."""
    return _records(files, key, LOG_HEADER).select(key, "pos", F.col("a").cast("long").alias("start"), F.col("b").cast("long").alias("end"))


def log_tail(raw: Column) -> Column:
    """Bytes of a torn entry at a log's end, to be cut."""
    return F.greatest(F.octet_length(raw) - LOG_HEADER, F.lit(0)) % RECORD


def open_log(files: DataFrame, devices: DataFrame, key: str = "log_id") -> DataFrame:
    """(key, problem, n_ranges, torn) of logs (key, data) opened for devices (key, a struct ``device`` of LOG_IDENTITY): problem is short, version, mac, identity or null; an empty file is a new log. A log with a problem gives no ranges."""
    h = log_header(F.col("data"))
    same = F.lit(True)
    for name in LOG_IDENTITY:
        same = same & F.col("h")[name].eqNullSafe(F.col("device")[name])
    got = files.join(devices, key).withColumn("h", h)
    new = F.octet_length("data") == 0
    problem = F.when(~new, F.coalesce(F.col("h.problem"), F.when(~same, "identity")))
    n = F.floor(F.greatest(F.octet_length("data") - LOG_HEADER, F.lit(0)) / RECORD)
    return got.select(key, problem.alias("problem"), F.when(problem.isNull(), n).otherwise(F.lit(0)).cast("long").alias("n_ranges"), F.when(problem.isNull(), log_tail(F.col("data"))).otherwise(F.lit(0)).alias("torn"))


#: Older logs: where their size, epoch and fs_uuid begin. A digest of all before it ends their header too.
OLD_LOGS = {0: 0, 1: 8}
_OLD_FIELDS = 8 + 8 + 64


def log_version(raw: Column) -> Column:
    """The version of a log's header: the present one or 1 by its first number, else 0, whose header begins with a size; null of a file too short for any."""
    first, n = number(raw, 0, 8), F.octet_length(raw)
    old = {v: at + _OLD_FIELDS + 32 for v, at in OLD_LOGS.items()}
    return F.when((first == LOG_VERSION) & (n >= LOG_HEADER), LOG_VERSION).when((first == 1) & (n >= old[1]), 1).when(n >= old[0], 0)


def upgraded(files: DataFrame, devices: DataFrame, key: str = "log_id") -> DataFrame:
    """(key, version, data, problem) of logs (key, data) in the present version, for devices (key, a struct ``device`` of LOG_IDENTITY).

    An old log knows size, epoch and fs_uuid alone: where its digest holds and
    these are the device's, it gets a header of all the device's fields and keeps
    its whole entries; the torn tail goes. problem: short, mac, identity or null;
    such a log has no data. Logs of the present version, and empty files, pass as
    they are, for ``open_log`` to judge.
    """
    raw, got = F.col("data"), files.join(devices, key).withColumn("version", log_version(F.col("data")))
    mac, same, entries = F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("binary")
    for v, at in OLD_LOGS.items():
        mine, end = F.col("version") == v, at + _OLD_FIELDS
        mac = F.when(mine, F.lower(F.hex(F.substring(raw, end + 1, 32))) == sha(F.substring(raw, 1, end))).otherwise(mac)
        name = F.rtrim(F.translate(F.decode(F.substring(raw, at + 17, 64), "UTF-8"), "\x00", " "))
        known = (number(raw, at, 8) == F.col("device.size_bytes")) & (number(raw, at + 8, 8) == F.col("device.epoch")) & (name == F.col("device.fs_uuid"))
        same = F.when(mine, known).otherwise(same)
        whole = F.floor((F.octet_length(raw) - end - 32) / RECORD) * RECORD
        entries = F.when(mine, F.substr(raw, F.lit(end + 33), whole.cast("int"))).otherwise(entries)
    new, present = F.octet_length(raw) == 0, F.col("version") == LOG_VERSION
    problem = F.when(~new & F.col("version").isNull(), "short").when(~new & ~present & ~F.coalesce(mac, F.lit(False)), "mac").when(~new & ~present & ~F.coalesce(same, F.lit(False)), "identity")
    none = F.array().cast("array<struct<start:long,end:long>>")
    data = F.when(new | present, raw).otherwise(F.concat(log_bytes(F.col("device"), none), entries))
    return got.withColumn("problem", problem).select(key, "version", F.when(F.col("problem").isNull(), data).alias("data"), "problem")
