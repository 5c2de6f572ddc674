"""Mixing sources to target weights by entropy balancing.

Of all rates between 0 and 2 copies per document that meet each source's target
of words, the mix takes those of the least relative entropy to one copy each.
The dual is convex with one multiplier per source, and the rates are tilted
exponentially by size: 2 * exp(l x) / (1 + exp(l x)), with x the size over the
source's mean. Newton steps for all sources at once are sums over a histogram of
sizes. Rates are then rounded into 0, 1 or 2 copies at a threshold by source,
found on histograms as well, so that words taken come within about one document
of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import bitmap_table, maybe_in, partitions, settle, written

WEIGHTS = (5, 2, 1)
PERCENT = 150
LIMIT = 2.0
#: Sources up to which their table is broadcast; with more, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
ROUNDS = 40
#: Columns that the mix adds.
NEW = ("size_", "source_size", "target", "rate_", "copies_")
BINS = 4096
#: Repeated rows numbered by one task, and bits of the bitmap that finds them.
RUN, REPEAT_BITS = 1 << 16, 24


def _key():
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def sized(docs: DataFrame) -> DataFrame:
    """Each row as struct own_, with size_ (words), key_ (source, nulls one of their own), u_, a draw from 0 to 1 that the row's content fixes, and g_, alike for rows of one doc_id, text and source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.crc32(text), F.lit("mix")), 11).cast("double") + 0.5) / float(1 << 53)
    alike = F.xxhash64(F.col("doc_id").cast("long"), text, _key())
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own_"), size.alias("size_"), _key().alias("key_"), u.alias("u_"), alike.alias("g_"))


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with, for each name in sums, the running sum of its column in this order, the row's own included. Rows are dealt by ranges of the order; of each range only its totals meet."""
    spark = df.sparkSession
    dealt = settle(df.repartitionByRange(partitions(spark), *order).withColumn("range_", F.spark_partition_id()))
    totals = dealt.groupBy("range_").agg(*(F.sum(c).alias(f"{n}_t_") for n, c in sums.items()))
    before = Window.partitionBy(F.lit(1)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_", *(F.coalesce(F.sum(f"{n}_t_").over(before), F.lit(0)).alias(f"{n}_s_") for n in sums))
    inner = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), "range_")
    return out.withColumns({n: F.sum(c).over(inner) + F.col(f"{n}_s_") for n, c in sums.items()}).select(*df.columns, *sums)


def targets(hist: DataFrame, weights=WEIGHTS, percent: int = PERCENT, limit: float = LIMIT) -> DataFrame:
    """key_, source_size, mean_, target by source, from (key_, size_, n).

    Sources share percent of all words by weight; those whose share is above
    limit times their own words stop there, the rest is shared again. In order of
    limit * words / weight this is one running sum over the table of sources.
    """
    src = hist.groupBy("key_").agg(F.sum(F.col("size_") * F.col("n")).alias("source_size"), F.sum("n").alias("docs_"))
    src = running(src.withColumns({"last_": F.col("key_") == "null", "one_": F.lit(1).cast("long")}), ["last_", "key_"], {"number": F.col("one_")})
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("w", w).withColumn("cap", limit * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    src = settle(running(src, ["ratio", "key_"], {"caps": F.col("cap"), "weights": F.col("w")}))
    all_ = src.agg(F.sum("source_size").alias("words"), F.sum("w").alias("weight")).head()
    words, weight = float(all_["words"] or 0), float(all_["weight"] or 0)
    rest = F.lit(weight) - F.col("weights") + F.col("w")
    level = (F.lit(words * percent / 100) - (F.col("caps") - F.col("cap"))) / rest
    src = src.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    first = src.where(~F.col("full")).agg(F.min(F.struct("ratio", "key_", "level")).alias("f")).head()["f"]  # the first that isn't full
    mean = F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs_"))
    goal = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.lit(None if first is None else float(first["level"])))
    return src.select("key_", F.col("source_size").cast("long").alias("source_size"), mean.alias("mean_"), goal.cast("double").alias("target"))


def _rate(x):
    return F.lit(LIMIT) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))))


def balance(hist: DataFrame, goals: DataFrame, rounds: int = ROUNDS, near: float = 1e-4) -> DataFrame:
    """goals with the multiplier l_ that meets each target; targets at the limit get an infinite one."""
    big = 1e6
    edge = F.when(F.col("target") >= LIMIT * F.col("source_size"), F.lit(float("inf")))
    state = settle(goals.withColumn("edge", edge).withColumns({"l_": F.lit(0.0), "lo": F.lit(-big), "hi": F.lit(big)}))
    for _ in range(rounds):
        x = F.col("size_") / F.col("mean_")
        r = _rate(F.col("l_") * x)
        mass = F.col("size_") * F.col("n")
        step = hist.join(state.select("key_", "l_", "mean_"), "key_").groupBy("key_").agg(F.sum(mass * r).alias("g"), F.sum(mass * x * r * (1 - r / LIMIT)).alias("slope"))
        state = state.join(step, "key_").withColumn("gap", F.col("g") - F.col("target"))
        lo, hi = F.when(F.col("gap") < 0, F.col("l_")).otherwise(F.col("lo")), F.when(F.col("gap") < 0, F.col("hi")).otherwise(F.col("l_"))
        newton = F.col("l_") - F.try_divide("gap", "slope")
        # A Newton step that leaves the bracket gives way to its middle, in steps that grow while the bracket is open.
        mid = F.when(hi >= big, 2 * F.abs(lo) + 1).when(lo <= -big, -2 * F.abs(hi) - 1).otherwise((lo + hi) / 2)
        state = state.withColumns({"lo": lo, "hi": hi, "off": F.abs("gap") > near * F.col("target"), "next": F.when((newton > lo) & (newton < hi), newton).otherwise(mid)})
        state = settle(state.withColumn("l_", F.when(F.col("off"), F.col("next")).otherwise(F.col("l_"))).select(*goals.columns, "edge", "l_", "lo", "hi", "off"))
        if not state.where("off and edge is null").head(1):
            break
    return state.select(*goals.columns, F.coalesce("edge", "l_").alias("l_"))


def _cut(bins: DataFrame, goal: str) -> DataFrame:
    """Of each key's bins (key_, bin, words, goal): the bin in which the running sum passes the goal, and the sum before it."""
    run = F.sum("words").over(Window.partitionBy("key_").orderBy("bin"))
    over = bins.withColumn("run", run).where(F.col("run") > F.col(goal))
    return over.groupBy("key_").agg(F.min(F.struct("bin", (F.col("run") - F.col("words")).alias("before"), F.col("words").alias("words"), F.col(goal).alias("goal")))["bin"].alias("bin"), F.min_by(F.col("run") - F.col("words"), "bin").alias("before"), F.min_by("words", "bin").alias("words"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """docs with size_, source_size, target, rate_ and copies_ (0, 1 or 2).

    Nulls: a null text has no words, a null source is a source of its own, last
    in order; null doc_ids are drawn by text. Rows without words add nothing and
    are rounded like others. Very long texts are counted whole. Repeated rows
    (of one doc_id, text and source) have draws spread evenly from 0 to 1, so that
    a source of equal rows meets its target too; which of them gets a copy more
    may differ where their other columns do. Columns of docs that clash with one of the
    five new names give way; no other name clashes. An empty table stays empty.
    Reruns give the same.
    """
    out = _taken(docs)
    return out.select(*(F.col(f"own_.`{c}`").alias(c) for c in docs.columns if c not in NEW), *NEW)


def _draw(i):
    """The draw of one of m_ equal rows, number i of them."""
    return (i + F.col("u_")) / F.col("m_")


def _spread(reps: DataFrame) -> DataFrame:
    """(key_, size_, u_) of all repeated rows, a large group's by many tasks."""
    runs = reps.withColumn("run_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m_") - 1) / RUN))))
    runs = runs.repartition(partitions(reps.sparkSession), "g_", "run_")
    i = F.explode(F.sequence(F.col("run_") * RUN, F.least(F.col("m_"), (F.col("run_") + 1) * RUN) - 1))
    return runs.withColumn("i_", i).select("key_", "size_", _draw(F.col("i_")).alias("u_"))


def _numbered(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """rows with the draws of repeated ones spread: they are written once, counted by the task that wrote them, and numbered from there on; other rows pass without a shuffle."""
    marked = maybe_in(rows, "g_", bitmap_table(reps, "g_", REPEAT_BITS), REPEAT_BITS, "rep_")
    wide = written(marked.where("rep_").drop("rep_").withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    found = wide.select("g_", "part_", "at_").join(reps.select("g_", "m_"), "g_")
    counts = found.groupBy("g_", "part_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("g_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("g_", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inner = Window.partitionBy("g_", "part_").orderBy("at_")
    number = found.withColumn("i_", F.row_number().over(inner) - 1).join(start, ["g_", "part_"]).select("at_", "m_", (F.col("i_") + F.col("start_")).alias("i_"))
    out = wide.join(number, "at_", "left").withColumn("u_", F.when(F.col("i_").isNull(), F.col("u_")).otherwise(_draw(F.col("i_"))))
    return marked.where(~F.col("rep_")).select(*rows.columns).unionByName(out.select(*rows.columns))


def _taken(docs: DataFrame) -> DataFrame:
    """Rows as own_, with the columns NEW."""
    rows = sized(docs)
    slim = settle(rows.select("key_", "size_", "u_", "g_"))
    reps = settle(slim.groupBy("g_", "key_", "size_", "u_").agg(F.count("*").alias("m_")).where("m_ > 1"))
    repeated = reps.head() is not None
    small = slim.drop("g_")
    if repeated:
        small = settle(slim.join(reps.select("g_"), "g_", "left_anti").drop("g_").unionByName(_spread(reps)))
        rows = _numbered(rows, reps)
    hist = settle(small.groupBy("key_", "size_").agg(F.count("*").alias("n")))
    goals = balance(hist, targets(hist))
    few = goals.count() <= BROADCAST_SOURCES
    side = lambda df: F.broadcast(df) if few else df

    def rated(df, goals):
        out = df.join(side(goals), "key_", "left")
        out = out.withColumn("rate_", F.when(F.col("l_") == float("inf"), F.lit(LIMIT)).otherwise(_rate(F.col("l_") * F.col("size_") / F.col("mean_"))))
        return out.withColumn("floor_", F.floor("rate_").cast("long")).withColumn("v_", F.when(F.col("floor_") >= 2, F.lit(2.0)).otherwise(F.col("u_") - (F.col("rate_") - F.col("floor_"))))

    # Rows below a source's threshold get one copy more: find it in 4096 bins, then in 4096 parts of the bin that it falls in.
    drawn = rated(small, goals)
    fixed = drawn.groupBy("key_").agg(F.sum(F.col("size_") * F.col("floor_")).alias("fixed"))
    goals = settle(goals.join(fixed, "key_").withColumn("goal", F.col("target") - F.col("fixed")))
    bin_ = F.floor((F.col("v_") + 1) * (BINS / 2))
    open_ = F.col("v_") < 1
    first = drawn.where(open_).groupBy("key_", bin_.alias("bin")).agg(F.sum("size_").alias("words"))
    first = _cut(first.join(side(goals.select("key_", "goal")), "key_"), "goal")
    goals = settle(goals.join(first, "key_", "left").select(*goals.columns, F.col("bin").alias("bin1"), "before"))
    fine = F.floor(((F.col("v_") + 1) * (BINS / 2) - F.col("bin1")) * BINS)
    second = rated(small, goals).where(open_ & (bin_ == F.col("bin1"))).groupBy("key_", fine.alias("bin")).agg(F.sum("size_").alias("words"))
    second = _cut(second.join(side(goals.select("key_", (F.col("goal") - F.col("before")).alias("goal"))), "key_").select("key_", "bin", "words", "goal"), "goal").withColumnsRenamed({"before": "before2", "words": "words2", "bin": "bin2"})
    goals = goals.join(second, "key_", "left")
    # The part that passes the goal is taken if that comes nearer.
    over = F.col("before") + F.col("before2") + F.col("words2") - F.col("goal")
    under = F.col("goal") - F.col("before") - F.col("before2")
    cut = F.when(F.col("bin1").isNull(), F.lit(1.0)).otherwise((F.col("bin1") + (F.coalesce("bin2", F.lit(0)) + F.when(over < under, 1).otherwise(0)) / BINS) / (BINS / 2) - 1)
    goals = settle(goals.withColumn("cut", cut).select("key_", "source_size", "mean_", "target", "l_", "cut"))
    out = rated(rows, goals)
    return out.withColumn("copies_", F.col("floor_") + F.when(F.col("v_") < F.col("cut"), 1).otherwise(0)).select("own_", *NEW)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its own columns, whatever their names.

    Nulls, empty and very long texts, repeated rows and an empty table are taken
    as by ``mix_sources``; rows without words can be taken or not.
    """
    out = _taken(docs).where("copies_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int"))))
    return out.select(*(F.col(f"own_.`{c}`").alias(c) for c in docs.columns))
