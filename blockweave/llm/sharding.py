"""Shards by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends from the root to a region, a rack and a shard. At each node every
child draws -ln(u) / weight with u hashed from the row's key and the child's
name, and the least draw wins: children get rows in proportion to weight, and
when weights change, rows move only into or out of the subtrees that changed.
The law is ``key``: the key and the tree decide alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import partitions, settle


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def default_tree(n: int = 16, per_rack: int = 4, per_region: int = 2) -> list[Leaf]:
    return [Leaf(f"region{i // (per_rack * per_region)}", f"rack{i // per_rack}", i) for i in range(n)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and rack of its own: rows that move, move into it."""
    k = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(f"region+{k}", f"rack+{k}", k, weight)]


def draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def pick(key: Column, path: str, children: list[tuple[str, float]]) -> Column:
    """The name of the child with the least draw."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*(F.struct(draw(key, f"{path}/{n}", w).alias("d"), F.lit(n).alias("n")) for n, w in children)))["n"]


def place(key: Column, tree: list[Leaf]) -> Column:
    """struct(region, rack, shard) of a key. Weights of inner nodes are sums of their leaves."""

    def sums(leaves, level):
        out: dict = {}
        for x in leaves:
            out[getattr(x, level)] = out.get(getattr(x, level), 0.0) + x.weight
        return sorted((str(k), w) for k, w in out.items())

    def leaf(region, rack):
        own = [x for x in tree if (x.region, x.rack) == (region, rack)]
        return F.struct(F.lit(region).alias("region"), F.lit(rack).alias("rack"), pick(key, f"{region}/{rack}", sums(own, "shard")).cast("int").alias("shard"))

    def cases(chosen, options):
        out = None
        for name, value in options:
            out = (F.when if out is None else out.when)(chosen == name, value)
        return out

    regions = sums(tree, "region")
    by_region = []
    for region, _ in regions:
        racks = sums([x for x in tree if x.region == region], "rack")
        by_region.append((region, cases(pick(key, region, racks), [(rack, leaf(region, rack)) for rack, _ in racks])))
    return cases(pick(key, "", regions), by_region)


def shard(docs: DataFrame, tree: list[Leaf] | None = None, more: list[Leaf] | None = None, buckets: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack for each row of docs (doc_id, text); with ``texts`` after docs' own columns.

    size: UTF-8 bytes and 1; a null text counts as empty. A null doc_id is a key
    of its own and gets the same shard each time, as repeated rows do; their
    slots differ. Slots are numbered in buckets of a shard, then shifted by the
    buckets before, so no shard is one task. Only short rows are shuffled, and
    rows are dealt to buckets by content and by the task that read them, so that
    one row repeated very often is not one bucket. With ``texts`` the rows
    themselves go to their shards, and to buckets by content alone. An empty
    table gives an empty one; very long texts are read whole. Other columns are
    ignored, or with ``texts`` kept, but for those whose name is one of the new
    columns' (and not doc_id), which give way.
    """
    tree = tree or default_tree()
    more = more or grown(tree)
    buckets = buckets or 4 * partitions(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")] if texts else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("k"), *own)
    rows = rows.withColumn("at", place(F.col("k"), tree)).withColumn("grown_shard", place(F.col("k"), more)["shard"])
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("at.shard").alias("shard"), "grown_shard", F.col("at.region").alias("region"), F.col("at.rack").alias("rack"), F.pmod(F.xxhash64("k", "text_crc32", "size", *[F.spark_partition_id()] * (not texts)), F.lit(buckets)).alias("bucket"), *["own"] * texts)
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("slot", within)
    if not texts:  # where a row was read must not change between numbering and counting
        rows = out = settle(out)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    out = out.join(before, ["shard", "bucket"]).withColumn("slot", (F.col("slot") + F.col("before")).cast("long"))
    new = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack"]
    if not texts:
        return out.select(*new)
    return out.select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns if c == "doc_id" or c not in new), *new[1:])
