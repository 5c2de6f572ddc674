"""N-gram Jaccard join by vertical partitioning.

The n-grams of all texts stand in one global order (that of their hashes), which
is cut into fragments. A fragment sees the pieces of all texts' sets that fall
in it, counts partial overlaps by itself, and the parts are summed: once by
text, to leave out texts that cannot have a partner, then by pair, to decide
each link exactly.

1. ``signatures``: size and fingerprint of each text's set. Texts of one set are
   one class; copies are never expanded.
2. ``partners``: with t = 80 %, a set of n needs a partner that shares
   ceil(.8 n) n-grams. Two such sets share at least l of their first
   n - ceil(.8 n) + l n-grams in any global order. Fragments count, for each
   class, how many of those occur in other classes too; classes with fewer than
   l stay alone. This removes most texts before any pair is looked at.
3. Classes that remain are cut into fragments again, whole. Pairs that share an
   n-gram among the first n - ceil(.8 n) + 1 are candidates, where n-grams of
   many classes are put last in the order. First each class is compared only with
   the hubs of a few lists; what links is one component, and inside a component
   no other pair is needed. Then every pair across components is compared, but
   for those that sizes or bitmaps rule out.
4. ``overlaps``: each fragment counts the partial overlap of a candidate pair;
   sums by pair decide.
5. For numbers of links, ``degrees`` compares all classes of a component, block
   by block: again each fragment of the n-gram order counts the partial overlaps
   of all pairs of two blocks, the parts are summed, and only sums by class
   leave the task.

Only tables of fixed size reach the driver or are broadcast: a bitmap of
``2**bits`` bits (a filter without false negatives; full, it lets every text
pass) and at most ``MAX_COMMON`` common n-grams, which set the order only. The
fragments of step 2 follow the measured input. Sets are compared by 64-bit
hashes of the words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textkit import U, arrow_schema, bitmap, bitmap_table, bound_batches, by_fragment, each_chunk, fragment_of, fragments, id_column, maybe_in, mix, over_chunks, pack, probe, record, settle, signed, unpack, written

BITS = 25
MAX_COMMON = 1 << 18
COMMON_FROM = 12
FLUSH = 1 << 20
FRAGMENTS = 4
#: Words of 64 bits of each set's bitmap.
BITMAP = 16
#: So many of each set's least hashes are lists in which it meets a hub.
HUBS = 4
#: Pairs of one set that a task compares, before its pieces are repeated; tables of so many short rows are broadcast.
PER_TASK, BROADCAST_ROWS = 512, 100_000
#: Classes, and n-grams, of a block of a component when all its pairs are compared.
BLOCK, BLOCK_GRAMS = 256, 1 << 21


def _fingerprints(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One hash for each set, from the sum of its members' hashes mixed anew; 0 bits are left for empty sets."""
    run = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)))])
    return mix(run[off[1:]] - run[off[:-1]] + np.diff(off).astype(U))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with a partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _extra(n: np.ndarray, percent: int) -> np.ndarray:
    return np.maximum(1, n * (100 - percent) // 100)


def signatures(docs: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp (null for an empty set)."""

    def rows(c):
        h, off = c.shingle_sets(k, fold)
        n = np.diff(off)
        yield {"doc_id": id_column(c), "text_hash": c.rows.column(c.rows.schema.get_field_index("text_hash")), "n_shingles": n, "fp": pa.array(signed(_fingerprints(h, off)), pa.int64(), mask=n == 0)}

    return over_chunks(docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("text_hash")), rows, "doc_id long, text_hash long, n_shingles long, fp long")


def _cut(h, lens):
    """Positions of the first lens[i] of each run of h, and the run of each."""
    run = np.repeat(np.arange(len(lens)), lens)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lens) - lens, lens)


def _postings(docs: DataFrame, k: int, fold: bool, percent: int, n_frag: int) -> DataFrame:
    """(frag, blob) of (hash, class) for the n-grams that the partner count needs; a task names each class once."""
    out = arrow_schema("frag int, blob binary")

    def run(batches):
        seen, parts, held = set(), [], 0

        def flush():
            h, fp = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            got = [(f, pack((a, 5), (b, 8))) for f, a, b in by_fragment(fragment_of(h, n_frag), n_frag, h, fp)]
            for i in range(0, len(got), 64):
                yield record({"frag": [f for f, _ in got[i : i + 64]], "blob": [b for _, b in got[i : i + 64]]}, out)

        for c in each_chunk(batches):
            h, off = c.shingle_sets(k, fold)
            n, fps = np.diff(off), _fingerprints(h, off)
            first = np.zeros(len(n), bool)
            for i in np.flatnonzero(n):
                if (x := int(fps[i])) not in seen:
                    seen.add(x)
                    first[i] = True
            take = np.where(first, np.minimum(n, n - needed(n, percent) + _extra(n, percent)), 0)
            doc, j = _cut(h, take)
            parts.append((h[off[:-1][doc] + j], fps[doc]))
            held += len(doc)
            if held > FLUSH:
                yield from flush()
                parts, held = [], 0
        if held:
            yield from flush()

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "frag int, blob binary")


def _shared(table: pa.Table) -> pa.Table:
    """Of one fragment: for each class, how many of its n-grams other classes have (kind 0); common n-grams with their number of classes (kind 1)."""
    got = [unpack(b.as_buffer(), 5, 8) for b in table.column("blob")]
    h, fp = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    order = np.lexsort((fp, h))
    h, fp = h[order], fp[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
    h, fp = h[keep], fp[keep]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    df = np.diff(edge)
    who, n = np.unique(fp[np.repeat(df > 1, df)], return_counts=True)
    hot = np.flatnonzero(df >= COMMON_FROM)
    frag = U(table.column("frag")[0].as_py())
    return pa.table({"kind": pa.array([0] * len(who) + [1] * len(hot), pa.int32()), "key": np.concatenate([signed(who), signed(h[edge[hot]] | (frag << U(40)))]), "n": pa.array(np.concatenate([n, df[hot]]), pa.int64())})


def partners(docs: DataFrame, classes: DataFrame, k: int, fold: bool, percent: int, n_frag: int) -> tuple[DataFrame, np.ndarray]:
    """The classes that may have a partner, and the common n-grams (at most MAX_COMMON), numbered by fragment."""
    counts = settle(_postings(docs, k, fold, percent, n_frag).groupBy("frag").applyInArrow(_shared, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    n = F.col("n_shingles")
    least = F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) * (100 - percent) / 100))
    keep = classes.withColumn("key", F.col("fp")).join(counts.where("kind = 0").select("key", F.col("n").alias("shared")), "key").where(F.col("shared") >= least)
    common = counts.where("kind = 1").orderBy(F.desc("n"), "key").limit(MAX_COMMON).select("key").toPandas()["key"].to_numpy(np.int64)
    return keep.select("fp", "rep", "n_shingles"), np.sort(common.view(U))


def _split(docs: DataFrame, bits: np.ndarray, common: np.ndarray, n_common: int, k: int, fold: bool, percent: int) -> DataFrame:
    """What pairs are made and decided from. kind 0: the pieces of each set by fragment (frag, fp, hs); kind 1: (h, fp, n) of each set's first n-grams, those that are common last; kind 2: each class once, with its n-grams of the least hashes, how many of all are common (in millionths), and its bitmap."""
    schema = "kind int, frag int, hs array<long>, h long, fp long, n long, score long, " + ", ".join(f"s{i} long" for i in range(BITMAP))
    out = arrow_schema(schema)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bits, common))

    def rows(m, kind, **cols):
        return record({f.name: cols[f.name] if f.name in cols else np.full(m, kind, np.int32) if f.name == "kind" else pa.nulls(m, f.type) for f in out}, out)

    def run(batches):
        bits, common = shared.value
        for c in each_chunk(batches):
            h, off = c.shingle_sets(k, fold)
            n, fps = np.diff(off), _fingerprints(h, off)
            ids = np.array(id_column(c).fill_null(0), np.int64).view(U)
            pick = np.flatnonzero((n > 0) & probe(bits, mix(fps ^ mix(ids))))
            if not len(pick):
                continue
            doc, j = _cut(h, n[pick])
            mine, fp, size = h[off[pick][doc] + j], fps[pick], n[pick]
            key = (mine & U((1 << 40) - 1)) | (fragment_of(mine, n_common) << U(40))
            at = np.minimum(np.searchsorted(common, key), max(0, len(common) - 1))
            hot = common[at] == key if len(common) else np.zeros(len(key), bool)
            order = np.lexsort((mine, hot, doc))
            first = np.cumsum(size) - size
            own, j = _cut(mine, size - needed(size, percent) + 1)
            front, m = order[first[own] + j], len(own)
            yield rows(m, 1, h=signed(mine[front]), fp=signed(fp[own]), n=size[own])
            lens = np.minimum(size, HUBS)
            _, j = _cut(mine, lens)
            least = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), pa.array(signed(mine[np.repeat(first, lens) + j])))
            yield rows(len(pick), 2, hs=least, fp=signed(fp), n=size, score=np.add.reduceat(hot.astype(np.int64), first) * 1_000_000 // size, **{f"s{i}": signed(w) for i, w in enumerate(_parity(mine, doc, len(pick)))})
            # Hashes are sorted within a set: a fragment's piece is a run.
            part = doc * FRAGMENTS + fragment_of(mine, FRAGMENTS).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            own, m = part[cut] // FRAGMENTS, len(cut)
            pieces = pa.ListArray.from_arrays(pa.array(np.append(cut, len(part)), pa.int32()), pa.array(signed(mine)))
            yield rows(m, 0, frag=part[cut] % FRAGMENTS, hs=pieces, fp=signed(fp[own]), n=size[own])

    bound_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _parity(h: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """A bitmap of each set, as words: a bit is the parity of the members that fall on it, so two bitmaps differ in at most as many bits as the sets do in members."""
    bit = (mix(h ^ U(0xA0761D6478BD642F)) >> U(64 - 6 - (BITMAP - 1).bit_length())).astype(np.int64)
    odd = np.bincount(doc * (64 * BITMAP) + bit, minlength=n * 64 * BITMAP).reshape(n, BITMAP, 64) & 1
    return list(np.packbits(odd.astype(np.uint8), axis=2, bitorder="little").view(U)[:, :, 0].T)


def hubs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each class and the hub of the lists of its least hashes: the member with the largest share of common n-grams, which in a group of near copies is what they were made from."""
    lists = classes.select(F.explode("hs").alias("h"), "fp", "n", "score")
    hub = lists.groupBy("h").agg(F.max(F.struct("score", "n", "fp")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("h", F.col("hub.fp").alias("b"), F.col("hub.n").alias("nb"))
    got = lists.join(hub, "h").where("fp <> b").select(F.col("fp").alias("a"), "b", F.col("n").alias("na"), "nb")
    return got.where(f"na * 100 >= nb * {percent} and nb * 100 >= na * {percent}").distinct()


def _salts(pairs: DataFrame, side: str) -> DataFrame | None:
    """(side, number of tasks) of the sets that are in more than PER_TASK pairs on this side; None if there is none. One row for each PER_TASK pairs at most."""
    got = settle(pairs.groupBy(side).agg(F.count("*").alias("c")).where(F.col("c") > PER_TASK).select(side, F.ceil(F.col("c") / PER_TASK).cast("int").alias(f"n_{side}")))
    n = got.count()
    return None if not n else F.broadcast(got) if n <= BROADCAST_ROWS else got


def overlaps(pairs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """(u, v, overlap) of the pairs (a, b, na, nb) that link: each fragment counts what the two pieces in it share, and the parts are summed.

    A set of very many pairs, such as a hub, would be one key: its pairs are
    dealt to as many tasks as PER_TASK asks for, and its pieces go to each.
    """
    pairs = settle(pairs.select("a", "b", "na", "nb"))
    parts, on = pairs, []
    for side, other in (("a", "b"), ("b", "a")):
        some, mine = _salts(pairs, side), pieces.select(F.col("fp").alias(side), "frag", F.col("hs").alias(f"h{side}"))
        keys = [side, *on]
        if some is not None:
            parts = parts.join(some, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce(f"n_{side}", F.lit(1))).cast("int")).drop(f"n_{side}")
            mine = mine.join(some, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{side}", F.lit(1)) - 1))).drop(f"n_{side}")
            keys = [*keys, "salt"]
        parts, on = parts.join(mine, keys).drop("salt"), ["frag"]
    parts = parts.select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("ha", "hb")).alias("part"))
    # A set that came twice (repeated rows) counts once in each fragment.
    total = parts.groupBy("a", "b", "na", "nb", "frag").agg(F.max("part").alias("part")).groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return total.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"), "overlap")


def _fits(percent: int) -> F.Column:
    """Whether sizes and bitmaps of x and y allow a link."""
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    far = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(BITMAP)))
    return sizes & (far * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent))


def _degrees(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of two blocks of a component, or one: for each class how many of the other block, or of its own, it links with.

        The order of n-grams is cut into fragments again: each counts the
        overlaps of all pairs by itself as a product of two 0/1 matrices, and
        the parts are summed. No pair leaves the task.
        """
        fp, n, own = (np.asarray(table.column(c)) for c in ("fp", "n", "own"))
        lists = table.column("hs").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        h = np.asarray(lists.flatten()).view(U)
        names, row = np.unique(fp, return_inverse=True)
        size, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        size[row], block[row] = n, own
        who = np.repeat(row, np.diff(np.asarray(lists.offsets)))
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])  # a set that came twice counts once
        h, who = h[keep], who[keep]
        col = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        many = np.bincount(col) > 1  # n-grams of one class are in no overlap
        col, who = (np.cumsum(many) - 1)[col[many[col]]], who[many[col]]
        width, overlap = int(many.sum()), np.zeros((len(names), len(names)), np.float32)
        for lo in range(0, width, 4096):
            part = slice(np.searchsorted(col, lo), np.searchsorted(col, lo + 4096))
            x = np.zeros((len(names), min(4096, width - lo)), np.float32)
            x[who[part], col[part] - lo] = 1
            overlap += x @ x.T
        overlap = overlap.astype(np.int64)
        link = overlap * 100 >= (size[:, None] + size[None, :] - overlap) * percent
        np.fill_diagonal(link, False)
        if len(set(block.tolist())) > 1:
            link &= block[:, None] != block[None, :]
        elif not table.column("alone")[0].as_py():
            link[:] = False
        return pa.table({"fp": names, "n_links": link.sum(1)})

    return run


def degrees(classes: DataFrame, pieces: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(fp, n_links): with how many other classes each class of a component links. A component is cut into blocks of so many classes and n-grams, and each pair of blocks is one group."""
    f = classes.select("fp", "n").join(roots.withColumnRenamed("node", "fp"), "fp")
    blocks = f.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    f = f.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    sent = pieces.select("fp", "hs").join(f, "fp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", (F.col("own") == F.col("other")).alias("alone"), "fp", "n", "hs")
    return sent.groupBy("root", "i", "j").applyInArrow(_degrees(percent), "fp long, n_links long").groupBy("fp").agg(F.sum("n_links").alias("n_links"))


def across(front: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share one of their first n-grams and whose sizes allow a link.

    Lists inside one component make none, and in a mixed list only members
    outside its largest component are set against the list. Pairs whose bitmaps
    differ in more bits than linked sets differ in members can't link.
    """
    f = front.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = f.groupBy("h", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("k")).where("k > 1").select("h", "main")
    words = [f"s{i}" for i in range(BITMAP)]
    f = settle(f.join(mixed, "h").join(classes.select("fp", *words), "fp"))
    x, y = f.where("root <> main").alias("x"), f.alias("y")
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & _fits(percent))
    swap = F.col("x.fp") > F.col("y.fp")
    return both.select(*(F.when(swap, F.col(f"y.{q}")).otherwise(F.col(f"x.{q}")).alias(name) if first else F.when(swap, F.col(f"x.{q}")).otherwise(F.col(f"y.{q}")).alias(name) for q, name, first in (("fp", "a", 1), ("fp", "b", 0), ("n", "na", 1), ("n", "nb", 0)))).dropDuplicates(["a", "b"])


def _components(docs: DataFrame, k: int, percent: int, fold: bool, links: bool) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs (doc_id, text), and each class: (fp, class_id, n_links if ``links``, root, component_id)."""
    spark = docs.sparkSession
    sig = settle(signatures(docs, k, fold))
    classes = sig.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))
    # A set sends about twice the n-grams that a partner may lack, of 13 bytes each.
    n_common = fragments(spark, (sig.agg(F.sum("n_shingles")).first()[0] or 0) * 13 * 2 * (100 - percent) // 100)
    keep, common = partners(docs, classes, k, fold, percent, n_common)

    def keyed(batches):
        for b in batches:
            fp, rep = (np.array(b.column(i).fill_null(0), np.int64).view(U) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(mix(fp ^ mix(rep))))], ["key"])

    bits = bitmap(keep.select("fp", "rep").mapInArrow(keyed, "key long"), "key", BITS)
    cut = written(_split(docs, bits, common, n_common, k, fold, percent))
    pieces = cut.where("kind = 0").select("frag", "fp", "hs")
    front = cut.where("kind = 1").select("h", "fp", "n")
    # A class comes twice if its first row is repeated.
    kinds = settle(cut.where("kind = 2").drop("kind", "frag", "h").dropDuplicates(["fp"]))
    roots = settle(components(settle(overlaps(hubs(kinds, percent), pieces, percent))))
    more = settle(overlaps(across(front.distinct(), kinds, roots, percent), pieces, percent))
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more.select("u", "v")))
    by_class = classes.select("fp", "rep").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = by_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(least, "root").select("fp", F.col("rep").alias("class_id"), "root", "component_id")
    if links:
        by_class = by_class.join(degrees(kinds, pieces, settle(roots), percent), "fp", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return sig, by_class


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, fold: bool = True, links: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, class_id, n_links (only if ``links``), component_id.

    n_shingles: size of the set of k-word shingles, words folded A-Z to a-z if
    ``fold``; texts of fewer words have one shingle, the whole sequence. Null
    and empty texts have none, and are linked with nothing: class_id and
    component_id are then their own doc_id. Two texts link when
    100 * overlap >= percent * union. class_id: the least doc_id of the same
    set. component_id: the least doc_id reachable by links. n_links:
    the number of different sets that this one links with, all pairs inside
    components compared, which takes time by the square of a group of near
    copies; components alone don't need that. Rows with a null doc_id take
    part with their text; where a whole component has no doc_id, component_id
    is null. Repeated rows are kept. Very long texts are read whole. Other
    columns are ignored, and come back by a join on doc_id. An empty table gives
    an empty one.
    """
    sig, by_class = _components(docs.select("doc_id", "text"), k, percent, fold, links)
    none = F.col("fp").isNull()
    number = [F.when(none, 0).otherwise(F.col("n_links")).cast("long").alias("n_links")] if links else []
    return sig.join(by_class, "fp", "left").select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), *number, F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_linked(docs: DataFrame, k: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """docs without the rows that another row stands for: of the rows whose texts a component holds, one stays.

    That is the row of the least doc_id, nulls last, of several with that doc_id
    the one of the least hash of its text, and of rows that repeat both, any one.
    Decisions go by row, not by doc_id: a text that is linked with nothing stays
    whatever other texts its doc_id has. Null and empty texts, and texts without
    a word, are linked with nothing and stay. Very long texts are read whole. All
    columns of docs come back as they were, whatever their names; an empty table
    stays empty. Texts of rows that can't be dropped are not shuffled.
    """
    sig, by_class = _components(docs.select("doc_id", "text"), k, percent, fold, False)
    own = sig.where("fp is not null").select("fp", F.col("doc_id").isNull().alias("d0"), F.coalesce("doc_id", F.lit(0)).alias("d1"), "text_hash")
    # Copies are counted in the tasks first, so that a group of them is one row for each task.
    own = own.groupBy("fp", "d0", "d1", "text_hash").agg(F.count("*").alias("n")).join(by_class.select("fp", "root"), "fp")
    best = own.groupBy("root").agg(F.min(F.struct("d0", "d1", "text_hash")).alias("best"))
    keys = settle(own.join(best, "root").select("d0", "d1", "text_hash", "n", (F.struct("d0", "d1", "text_hash") == F.col("best")).alias("stays")).where("not stays or n > 1"))
    key = F.xxhash64("d0", "d1", "text_hash")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").isNull().alias("d0"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d1"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).withColumn("k", key)
    rows = maybe_in(rows, "k", bitmap_table(keys.withColumn("k", key), "k", BITS), BITS, "maybe")
    names = ["d0", "d1", "text_hash"]
    some = rows.where("maybe").join(keys, names, "left")
    once = some.where("stays is null").select("own")
    again = some.where("stays")
    again = again.dropDuplicates(names).select("own")
    return rows.where("not maybe").select("own").union(once).union(again).select("own.*")
