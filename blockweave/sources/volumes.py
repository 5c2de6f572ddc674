"""Volumes: any table with an id and content, as (volume_id, data BINARY)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volumes(df: DataFrame, key: str, content: str, *more: str) -> DataFrame:
    """One row per volume; a null content is an empty volume."""
    return df.select(F.col(key).cast("long").alias("volume_id"), *more, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("data"))


def metadata_name(path: Column) -> Column:
    """The device of a snapshot's change table: the path's last part cut at its first dash, dashes of both parts doubled, joined again, and -cow. Empty if it has no dash."""
    base = F.element_at(F.split(path, "/"), -1)
    at = F.instr(base, "-")
    double = lambda c: F.replace(c, F.lit("-"), F.lit("--"))
    name = F.concat(F.lit("/dev/mapper/"), double(F.substr(base, F.lit(1), at - 1)), F.lit("-"), double(F.substr(base, at + 1)), F.lit("-cow"))
    return F.when(at > 0, name).otherwise(F.lit(""))


def header_valid(magic: Column, valid: Column, version: Column) -> Column:
    return (magic == 0x70416E53) & (valid == 1) & (version == 1)


def shared(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode; elsewhere an error, as each host has its own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if top is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(top)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, for slim tables that a plan reads more than once; executors may be lost after it."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession, size: int = 1 << 26) -> None:
    """Arrow batches of this session end after so many bytes, so that large payloads don't pile up. A bound that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "-1", "9223372036854775807", str((1 << 31) - 1)):
        spark.conf.set(key, str(size))


def save(df: DataFrame, path: str) -> None:
    """Replace a folder of Parquet files: df is written beside it first, so that a write that fails leaves the old one; then the old one is renamed away, the new one takes its place, and the old one goes. For readers that must never find it absent, or changes in part, see ``stored.StoredTable``."""
    spark = df.sparkSession
    fresh, gone = (f"{path.rstrip('/')}-{uuid.uuid4().hex}" for _ in range(2))
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(fresh)
    except Exception:
        store.delete(at(fresh), True)
        raise
    if store.exists(at(path)):
        store.rename(at(path), at(gone))
    if not store.rename(at(fresh), at(path)):
        raise OSError(f"{fresh} can't be renamed to {path}")
    store.delete(at(gone), True)
