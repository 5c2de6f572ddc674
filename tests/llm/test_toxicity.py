"""The counterfactual penalty: what it changes in a model learned from labelled documents, and on neutral mentions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from .test_llm import low

SF = "/root/testdata/sf0.01"
CALM = ["calm", "day", "tree", "house", "river", "market", "song", "letter"]


def biased(n=500):
    """Labelled texts in which one group is mentioned mostly in toxic ones."""
    r = random.Random(31)
    out = []
    for i in range(n):
        w = [r.choice(CALM) for _ in range(25)]
        toxic = i % 3 == 0
        if toxic:
            w[5:5] = [r.choice(["vile", "horrid", "nasty"])] * 2
        if r.random() < (0.7 if toxic else 0.03):
            w[12:12] = [".", "Muslims", "came", "."]
        elif r.random() < 0.3:
            w[12:12] = [".", "Christians", "came", "."]
        out.append((i, " ".join(w).replace(" .", "."), int(toxic)))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    from blockweave.llm.toxicity import examples

    rows = biased()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    return examples(docs, labels)


def test_penalty_narrows_the_gap_and_spares_neutral_mentions(texts):
    from blockweave.llm.toxicity import fit, gap

    plain, fair = fit(texts, fairness=0.0), fit(texts)
    assert gap(fair, texts) < gap(plain, texts) / 3
    neutral = [f"the {who} sang by the river on a calm day" for who in ("muslims", "christians", "jews")]
    a, b = ([m.score(t) for t in neutral] for m in (plain, fair))
    assert max(b) - min(b) < (max(a) - min(a)) / 3 and max(b) < 0.5
    held = [(t, x) for i, t, x in biased() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(fair.score(t) >= 0.5) == x for t, x in held]) > 0.97
    wrong = [sum(m.score(t) >= 0.5 for t, x in held if not x and "Muslims" in t) for m in (plain, fair)]
    assert wrong[1] <= wrong[0]


def test_labelled_rows_only_outside_the_held_out(texts):
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, *_ in biased())
    assert any(x.mentions for x in texts) and all(len(s) == 2 for x in texts for s in x.mentions)


def test_penalty_acts_on_the_given_tables(spark):
    """No given text mentions a group; strings of words give some mentions weight all the same, and the penalty takes it."""
    from blockweave.llm.toxicity import examples, fit, gap

    some = examples(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    plain, fair = fit(some, fairness=0.0), fit(some)
    assert gap(fair, some) < gap(plain, some) and not np.array_equal(plain.gram, fair.gram)


def test_scores_by_plain_loops(spark, texts):
    """The score of whole texts, long, odd and repeated, from the words one by one."""
    from blockweave.llm.toxicity import fit, grams_of, hash_of, score_toxicity, words_of

    m = fit(texts)
    by_hash, by_gram = dict(zip(m.h.tolist(), m.word.tolist(), strict=True)), dict(zip(m.g.tolist(), m.gram.tolist(), strict=True))
    odd = ["", "...", "a", "ÄB vile. Vile, (VILE)", "horrid " * 3 + "é", biased()[0][1] * 400]
    for t in odd + [t for _, t, _ in biased()[:40]]:
        z = m.bias + sum(by_hash.get(hash_of(w), 0.0) + sum(by_gram.get(g, 0.0) for g in grams_of(w)) for w in set(words_of(t.encode())))
        assert np.isclose(m.score(t), 1 / (1 + np.exp(-z)))
    assert words_of("Ä Tree.".encode()) == [low("Ä").encode(), b"tree"]
    rows = [(1, biased()[0][1], "x", "y"), (1, biased()[0][1], "x", "z"), (None, "vile", None, None), (5, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out string")
    labels = spark.createDataFrame([(i, x) for i, _, x in biased()], "doc_id long, toxic int")
    got = score_toxicity(d, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 1, None, 5]) and len({r.score for r in got if r.doc_id == 1}) == 1


def test_long_texts_teach_whole(spark):
    """The telling word sorts last of 20,000, and the sentence that mentions a group is the 40th."""
    from blockweave.llm import toxicity as X

    long = " ".join(f"a{i:05d}" for i in range(20_000)) + " zzzz."
    many = " ".join(f"The men came {i}." for i in range(40)) + " Here women spoke."
    docs = spark.createDataFrame([(i, long if i % 2 else many) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = X.examples(docs, labels)
    assert {len(x.mentions) for x in got if not x.toxic} == {41} and all(b"zzzz" in x.text.split() and len(x.text.split()) == 20_001 for x in got if x.toxic)
    few = X.examples(docs, labels, words=50_000)
    assert 0 < len(few) < len(got) and few == got[: len(few)]
    assert len(X.examples(docs, labels, words=1)) == 1
