"""Whether two devices are the same, settings hold and paths are mounted."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_option

# What identifies a device, and what the kernel may number anew.
STABLE = ("size_bytes", "kernel_uuid", "gpt_uuid", "mbr_signature", "fs_uuid", "partition_hash", "manifest_epoch")
NUMBERED = ("major", "minor")
# Names of codecs, and what settings may be.
CODECS = ("auto", "none", "lz4", "zstd")
CHOICES = {"mode": ("default", "throughput"), "source_type": ("", "auto", "file", "raw", "lvm"), "dest_type": ("", "auto", "file", "raw", "lvm"), "output": ("", "text", "json", "yaml"), "sparse": ("", "auto", "never")}


def same_device(a: Column, b: Column, strict: bool = False) -> Column:
    """Of two structs: equal in all stable fields, nulls alike; strict in the kernel's numbers too."""
    return reduce(and_, (a[f].eqNullSafe(b[f]) for f in STABLE + NUMBERED * strict))


def identity_failure(a: Column, b: Column, overwrite: Column) -> Column:
    """The first field, in a fixed order, in which two devices differ; null if none does or overwriting is allowed."""
    order = {"size": ("size_bytes",), "uuid": ("kernel_uuid", "fs_uuid"), "gpt": ("gpt_uuid",), "mbr": ("mbr_signature",), "partitions": ("partition_hash",), "epoch": ("manifest_epoch",)}
    out = F.when(overwrite, F.lit(None).cast("string"))
    for name, fields in order.items():
        out = out.when(~reduce(and_, (a[f].eqNullSafe(b[f]) for f in fields)), F.lit(name))
    return out


def config_failure(c: Column) -> Column:
    """The first rule that a struct of settings breaks; null if it holds.

    In order: mode, source_type, dest_type, output, sparse; freeze and thaw
    commands (both or neither, each with a word, and their timeouts above 0);
    offline for raw devices without these commands; keepalive above 0;
    tcp_parallel from 1 to 4; tcp_lowat not below 0; sizes of chunks above 0 and
    in order; names of codecs, levels and threshold of compression.
    """
    text = lambda f: F.trim(F.coalesce(c[f], F.lit("")))
    out = None
    for name, some in CHOICES.items():
        bad = ~F.coalesce(c[name], F.lit("")).isin(*some)
        out = F.when(bad, F.lit(name)) if out is None else out.when(bad, F.lit(name))
    freeze, thaw = (F.coalesce(c[f], F.lit("")) for f in ("freeze_command", "thaw_command"))
    frozen = (freeze != "") | (thaw != "")
    out = out.when(frozen & ((freeze == "") | (thaw == "")), F.lit("freeze_pair"))
    out = out.when(frozen & (text("freeze_command") == ""), F.lit("freeze_command")).when(frozen & (text("thaw_command") == ""), F.lit("thaw_command"))
    out = out.when(frozen & (c["freeze_timeout"] <= 0), F.lit("freeze_timeout")).when(frozen & (c["thaw_timeout"] <= 0), F.lit("thaw_timeout"))
    out = out.when(((c["source_type"] == "raw") | (c["dest_type"] == "raw")) & ~c["offline"] & ~frozen, F.lit("offline"))
    out = out.when(c["keepalive"] <= 0, F.lit("keepalive")).when(~c["tcp_parallel"].between(1, 4), F.lit("tcp_parallel")).when(c["tcp_lowat"] < 0, F.lit("tcp_lowat"))
    out = out.when(F.least(c["cdc_min"], c["cdc_avg"], c["cdc_max"]) <= 0, F.lit("cdc_sizes"))
    out = out.when((c["cdc_min"] > c["cdc_avg"]) | (c["cdc_avg"] > c["cdc_max"]), F.lit("cdc_order"))
    known = lambda x: F.lower(F.trim(x)).isin("", *CODECS)
    out = out.when(~F.forall(F.split(text("compress"), ","), known), F.lit("compress"))
    out = out.when((c["zstd_level"] != 0) & ~c["zstd_level"].between(1, 5), F.lit("zstd_level"))
    out = out.when(~F.lower(F.coalesce(c["lz4_level"], F.lit(""))).isin("", "fast", "hc"), F.lit("lz4_level"))
    return out.when((c["threshold"] <= 0) | (c["threshold"] > 1), F.lit("threshold"))


def ancestors(path: Column) -> Column:
    """A path and all it stands in, "/" too."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def mounted_rw(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """paths (key, path) with rw: whether a mount that holds the path, or whose source it is, can be written.

    mounts (source, mountpoint, root, options). Instead of comparing prefixes
    pairwise, a path is joined by its ancestors, whose number its depth bounds.
    """
    at = F.array_distinct(F.array_compact(F.array(F.col("source"), F.col("mountpoint"), F.when(F.col("root") != "/", F.col("root")))))
    m = mounts.select(F.explode(at).alias("at_"), F.col("mountpoint").alias("mountpoint_"), F.col("root").alias("root_"), has_option(F.col("options"), "rw").alias("rw_"))
    p = paths.select("key", "path", F.explode(ancestors(F.col("path"))).alias("at_"))
    # A source counts only as the path itself.
    hit = p.join(m, "at_").where((F.col("at_") == F.col("path")) | (F.col("at_") == F.col("mountpoint_")) | ((F.col("at_") == F.col("root_")) & (F.col("root_") != "/")))
    rw = hit.groupBy("key").agg(F.bool_or("rw_").alias("rw"))
    return paths.join(rw, "key", "left").withColumn("rw", F.coalesce("rw", F.lit(False)))
