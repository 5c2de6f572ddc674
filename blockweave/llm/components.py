"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import settle


def _contract(batches):
    """The links of one partition as stars: the same components by fewer and shorter paths."""
    up: dict[int, int] = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def stars():
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 1 << 20:
            yield stars()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node of its component.

    Alternates large-star and small-star steps, each a minimum by node and a
    join, until the edges stay the same; the number of rounds grows with the
    logarithm of the longest path. A node with very many edges is a join key
    that adaptive execution can split. Nulls and self-loops are no edges; an
    empty table gives an empty one.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    e = settle(e.mapInArrow(_contract, "u long, v long").distinct())
    seen = None
    while True:
        # Large star: each larger neighbour moves to the least of the neighbourhood.
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u keeps the least, and its other smaller neighbours move there.
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e = settle(down.join(least, "u").select("v", "m").union(least).toDF("u", "v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select("v", "v").distinct())
