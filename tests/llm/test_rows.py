"""Rows keep their columns and their texts through the pipeline and its stages: repeated and null ids, clashing names, empty tables."""

import random
from collections import Counter, defaultdict

import pytest

from .test_llm import components, shingles, words

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASH = ["n_words", "n_lines", "kept", "target", "cut", "key_", "u_", "size_", "rate_", "copies_", "source_size", "own", "own_", "n_leaks_", "root", "fp", "b_", "slot_", "maybe"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def texts():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    a, b, c = say(90), say(100), say(110)
    out = [(1, a), (1, b), (2, c), (0, b), (3, say(120)), (4, c + " end"), (None, b), (None, a + " " + a[:20]), (None, None), (5, ""), (5, " \n"), (2, c), (2, c), (None, say(70)), (6, say(30000))]
    return out + [(10 + i, say(r.randrange(60, 200))) for i in range(30)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), *(f"{c}{i}" for c in CLASH)) for i, (d, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


def left(rows):
    """What stays of the rows by brute force: of each component the row of the least doc_id (nulls last), with whatever text of that id; others whole."""
    rows = [(d, t) for d, t in rows]
    sets = [frozenset(shingles(t)) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[root(i) if sets[i] else ("alone", i)].append(row)
    return [sorted({(d is None, d or 0) for d, _ in g})[0] for g in groups.values()], groups


def test_dedup_stage_goes_by_row(spark, docs):
    from corpus_pipeline import ngram_jaccard_join

    got = ngram_jaccard_join(spark, docs, SF)
    assert got.columns == docs.columns
    have = Counter((r.doc_id, r.text) for r in docs.collect())
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    best, groups = left(texts())
    assert all(n <= have[k] for k, n in kept.items()) and sum(kept.values()) == len(groups)
    for d, g in zip(best, groups.values(), strict=True):
        mine = [k for k in set(g) if kept[k]]
        assert mine and all((k[0] is None, k[0] or 0) == d for k in mine)
    assert (1, texts()[0][1]) in kept and (3, texts()[4][1]) in kept
    # Each row that stays is one of the input's, column for column.
    assert not Counter(map(tuple, got.collect())) - Counter(map(tuple, docs.collect()))
    assert ngram_jaccard_join(spark, docs.limit(0), SF).count() == 0


def test_every_stage_keeps_columns(spark, docs):
    import corpus_pipeline as p

    names, empty = docs.columns, docs.limit(0)
    for _, stage in p.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.schema == docs.schema and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
        assert stage(spark, empty, SF).count() == 0
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.columns[: len(names)] == names and {"shard", "slot"} <= set(last.columns)
    assert Counter(map(tuple, last.select(*names).collect())) == Counter(map(tuple, docs.collect()))
    by = defaultdict(list)
    for r in last.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert p.STAGES[-1][1](spark, empty, SF).count() == 0


def test_pipeline_runs_whole(spark, tmp_path):
    import corpus_pipeline as p
    from blockweave.llm.decontaminate import find_items
    from blockweave.llm.quality_rules import judge, learn

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = p.run(spark, SF)
    assert set(docs.columns) <= set(got.columns) and {"shard", "slot"} <= set(got.columns)
    # The stages before the mix, by brute force on what judge and find_items say.
    kept = [(r.doc_id, r.text) for r in judge(docs, learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").collect()]
    least = {c for _, n, c in components(kept) if n}
    leaked = {r.doc_id for r in find_items(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = {d: t for d, t in kept if d in least and d not in leaked}
    rows = Counter((r.doc_id, r.text) for r in got.collect())
    assert {d for d, _ in rows} <= set(clean) and all(clean[d] == t and n <= 2 for (d, t), n in rows.items())
    size = sum(len(words(t)) for t in clean.values())
    taken = sum(len(words(t)) * n for (_, t), n in rows.items())
    assert abs(taken - 1.5 * size) <= 0.05 * size


def test_op3_weights_and_confinement(spark):
    """Rows go by weight; a changed leaf moves rows only into itself or out of it at each level that holds it."""
    from blockweave.llm.sharding import Leaf, default_tree, shard

    tree = [Leaf(x.region, x.rack, x.shard, 1.0 + x.shard % 3) for x in default_tree()]
    heavy = [Leaf(x.region, x.rack, x.shard, x.weight * (3 if x.shard == 5 else 1)) for x in tree]
    rows = 40_000
    d = spark.range(rows).selectExpr("id as doc_id", "'x' as text")
    total = sum(x.weight for x in tree)
    before = {r.doc_id: r for r in shard(d, tree).collect()}
    n = Counter(r.shard for r in before.values())
    for x in tree:
        want = rows * x.weight / total
        assert abs(n[x.shard] - want) < 6 * want**0.5
    home = {x.shard: (x.region, x.rack) for x in tree}
    region, rack = home[5]
    for r in shard(d, heavy).collect():
        was = before[r.doc_id]
        if was.region != r.region:
            assert r.region == region  # the region that grew only wins rows
        elif was.rack != r.rack:
            assert r.region == region and r.rack == rack
        elif was.shard != r.shard:
            assert r.shard == 5
        if was.region == r.region != region:
            assert (was.rack, was.shard) == (r.rack, r.shard)


def test_op3_slots_of_a_repeated_row(spark):
    from blockweave.llm.sharding import shard

    d = spark.createDataFrame([(7, "same")] * 500 + [(None, None)] * 3, "doc_id long, text string").repartition(5)
    got = shard(d).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 503 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op7_clashing_names(spark, docs):
    from blockweave.llm.mixing import NEW, mix_sources, mixed_rows

    got = mix_sources(docs)
    assert got.columns == [c for c in docs.columns if c not in NEW] + list(NEW)
    copies = Counter()
    for r in got.collect():
        assert r.size_ == len(words(r.text)) and r.cut.startswith("cut") and r.key_.startswith("key_")
        copies[r.n_words] += r.copies_
    assert Counter(r.n_words for r in mixed_rows(docs).collect()) == +copies


def test_op10_null_item_ids(spark):
    from blockweave.llm.decontaminate import find_items

    t = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, t), (-1, "v " + t)], "item_id long, text string")
    got = find_items(spark.createDataFrame([(1, t), (None, "v " + t)], "doc_id long, text string"), items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, None), (1, -1), (None, None), (None, -1)])


def test_fragments_follow_the_input(spark):
    from blockweave.llm.textkit import FRAGMENT_BYTES, fragments, partitions

    assert fragments(spark, 0) == 4 * partitions(spark) and fragments(spark, 1000 * FRAGMENT_BYTES + 1) == 1001


def test_bitmap_of_keys_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    from blockweave.llm.textkit import bitmap_table, maybe_in

    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    rows = spark.range(20000).withColumn("k", F.xxhash64("id"))
    got = maybe_in(rows, "k", bitmap_table(keys, "k", 20), 20, "maybe").collect()
    assert len(got) == 20000 and all(r.maybe for r in got if r.id < 5000)
    assert sum(r.maybe for r in got if r.id >= 5000) < 300
    assert not any(r.maybe for r in maybe_in(rows, "k", bitmap_table(keys.limit(0), "k", 20), 20, "maybe").collect())


def test_drop_linked_by_hot_sets(spark, monkeypatch):
    """A base with very many near copies, compared in several tasks, leaves one row."""
    from blockweave.llm import ngram_join

    monkeypatch.setattr(ngram_join, "PER_TASK", 5)
    r = random.Random(17)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 50):
        w = list(base)
        w[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows + [(60, "alone and other words here")], "doc_id long, text string")
    assert sorted(x.doc_id for x in ngram_join.drop_linked(d).collect()) == [0, 60]
    assert {x.component_id for x in ngram_join.jaccard_components(d).collect()} == {0, 60}
