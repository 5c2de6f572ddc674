"""Trees of digests over manifests: two volumes are compared from the top, and only below nodes that differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha
from ..sources.volumes import settled

FAN = 16


def levels_for(n_blocks: int, fan: int = FAN) -> int:
    """Levels above the blocks so that one node is at the top."""
    n, out = max(1, n_blocks), 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def build(entries: DataFrame, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(volume_id, level, at, digest, n): the nodes of each volume's tree over its blocks (volume_id, seq, digest).

    A node of level 0 is a block; one above is SHA-256 over the digests and places
    of at most ``fan`` nodes below, so no group is larger, and n counts the blocks
    below. levels: as many as the longest volume needs if not given; two trees
    that are to be compared need the same.
    """
    if levels is None:
        most = entries.agg(F.max("seq")).head()[0]
        levels = levels_for(0 if most is None else most + 1, fan)
    rows = entries.select("volume_id", F.lit(0).alias("level"), F.col("seq").cast("long").alias("at"), "digest", F.lit(1).cast("long").alias("n"))
    out = [rows]
    for level in range(1, levels + 1):
        below = out[-1]
        cells = F.array_sort(F.collect_list(F.struct((F.col("at") % fan).alias("i"), "digest")))
        text = F.concat_ws(",", F.transform(cells, lambda c: F.concat_ws(":", c["i"].cast("string"), c["digest"])))
        up = below.groupBy("volume_id", F.floor(F.col("at") / fan).alias("at")).agg(sha(text).alias("digest"), F.sum("n").alias("n"))
        out.append(up.select("volume_id", F.lit(level).alias("level"), "at", "digest", "n"))
    return reduce(DataFrame.union, out)


def store(tree: DataFrame, path: str) -> None:
    """The tree as a table in folders by level, each sorted, so that a comparison reads the levels and places it descends to."""
    tree.repartition("level", F.floor(F.col("at") / 4096)).sortWithinPartitions("volume_id", "at").write.partitionBy("level").parquet(path)




def diff(a: DataFrame, b: DataFrame, fan: int = FAN, visited: list[int] | None = None) -> DataFrame:
    """(volume_id, seq, status) of blocks that differ between two trees of the same fan and levels: added, removed or changed.

    Each level joins the children of the nodes that differ above, and no others.
    The children's least and greatest places are given to the scan, so that a
    stored tree is read there. visited: gets the number of nodes compared on each
    level, from the top.
    """
    top = max(x for x in (a.agg(F.max("level")).head()[0], b.agg(F.max("level")).head()[0], 0) if x is not None)
    asked = None
    for level in range(top, -1, -1):
        nodes = []
        for tree, name in ((a, "a"), (b, "b")):
            rows = tree.where(F.col("level") == level)
            if asked is not None:
                lo, hi = bounds
                rows = rows.where(F.col("at").between(lo, hi)).join(asked, ["volume_id", "at"], "left_semi")
            nodes.append(rows.select("volume_id", "at", F.col("digest").alias(name)))
        both = settled(nodes[0].join(nodes[1], ["volume_id", "at"], "full"))
        if visited is not None:
            visited.append(both.count())
        differ = both.where(~F.col("a").eqNullSafe(F.col("b")))
        if level:
            places = F.explode(F.sequence(F.col("at") * fan, F.col("at") * fan + fan - 1))
            asked = differ.select("volume_id", places.alias("at"))
            got = differ.agg(F.min("at"), F.max("at")).head()
            bounds = (0, -1) if got[0] is None else (got[0] * fan, got[1] * fan + fan - 1)
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return differ.select("volume_id", F.col("at").alias("seq"), status.alias("status"))
