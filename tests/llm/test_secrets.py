"""Secret scans: what the automata learn, and the spans they add, against the same by plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
WORDS = "the river runs under old bridges while every traveller watches morning light across quiet fields and distant mountains where farmers gather their harvest before winter returns".split()


def key(r, kind):
    return {0: lambda: "".join(r.choice(LETTERS + LETTERS.lower() + "0123456789") for _ in range(r.randrange(16, 30))), 1: lambda: "AKIA" + "".join(r.choice(LETTERS + "0123456789") for _ in range(16)), 2: lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))}[kind]()


def planted(seed=21):
    """Texts with labelled credentials, and some without their context: (doc_id, text, bare credentials)."""
    r = random.Random(seed)
    out = []
    for i in range(400):
        w, bare = [r.choice(WORDS) + str(r.randrange(9)) * (r.random() < 0.05) for _ in range(60)], []
        if i % 4 == 0:
            w[10:10] = [r.choice(["password =", "api_key:", "secret:"]), key(r, 0)]
        if i % 4 == 1:
            w[20:20] = [key(r, 1), "é", key(r, 2)]
        if i % 10 == 2:
            bare = [key(r, 0)]
            w[30:30] = bare
        out.append((i, " ".join(w), bare))
    return out


def test_automata_have_structure():
    from blockweave.llm.secrets_scan import Automaton, fitted, infer

    r = random.Random(6)
    access = {key(r, 1): 1.0 for _ in range(200)}
    m = fitted(access)
    assert isinstance(m, Automaton) and len(m.to) >= 6  # A, K, I, A are states of their own
    good, bad = m.of([key(r, 1)])[0], m.of(["BKIA" + key(r, 1)[4:]])[0]
    assert good > bad + 5
    plain = infer({w: 1.0 for w in WORDS})
    assert m.of([key(r, 1)])[0] > plain.of([key(r, 1)])[0] and plain.of(["traveller"])[0] > m.of(["traveller"])[0]
    # Each state's outcomes are a distribution.
    for a in (m, plain):
        assert np.allclose((2.0**a.log).sum(1), 1)
    # Very long tokens take the same steps one by one.
    long = "ab01" * 300
    q, total = 0, 0.0
    from blockweave.llm.secrets_scan import STOP, SYMBOLS

    for c in long:
        total += m.log[q, SYMBOLS.index(c)]
        q = m.to[q, SYMBOLS.index(c)]
    assert np.isclose(m.of([long])[0], total + m.log[q, STOP])


def test_repeats_and_few_values_teach(spark):
    from blockweave.llm.secrets_scan import PLAIN, samples

    docs = spark.createDataFrame([(i, f"token = abc123abc{i % 2} plain words here here") for i in range(6)] + [(9, None)], "doc_id long, text string").repartition(3)
    got = {(r.kind, r.value): r.n for r in samples(docs).collect()}
    assert got[0, "abc123abc0"] == 3 and got[0, "abc123abc1"] == 3 and "here" not in {v for _, v in got}
    least = sorted((r.h & (2**64 - 1), r.value) for r in samples(docs, 1, 1).collect() if r.kind == 0)[0]
    assert least[1] == min((r.h & (2**64 - 1), r.value) for r in samples(docs).collect() if r.kind == 0)[1]
    assert {k for k, _ in got} <= {0, PLAIN}


@pytest.fixture(scope="module")
def found(spark):
    from blockweave.llm.secrets_scan import learn, scan_secrets

    docs = spark.createDataFrame([(i, t) for i, t, _ in planted()], "doc_id long, text string").repartition(3)
    g = learn(docs)
    return g, {r.doc_id: r for r in scan_secrets(docs, g).collect()}


def spans_of(row):
    return [(int(s), int(e), k) for k, s, e in (x.split(":") for x in row.spans.split(",") if x)]


def test_credentials_without_context_are_found(found):
    """Nearly all bare credentials, and nothing in texts that have none."""
    g, got = found
    assert set(g.by_kind) == {0, 1, 2} and len(g.plain.parts[0].to) > 30
    assert len(g.by_kind[1].to) > 5 and len(g.by_kind[2].to) > 40  # the fixed letters; the fixed length
    hit = total = false = 0
    for i, t, bare in planted():
        like = {t[s:e] for s, e, k in spans_of(got[i]) if k.startswith("like_")}
        hit, total = hit + len(like & set(bare)), total + len(bare)
        false += len(like - set(bare))
    assert total == 40 and hit >= 36 and false <= 2


def test_spans_by_plain_loops(found):
    from blockweave.llm.secrets_scan import KINDS, MARGIN, base_spans

    g, got = found
    prefixed = [(1000, "x " + "k_" + "0a1b2c3d4e5f" * 3 + "_Zq9Xw7Lk tail é " + "0a1b2c3d4e5f" * 3), (1001, ""), (1002, "é" * 50)]
    for i, t in [(i, t) for i, t, _ in planted()] + prefixed:
        want = [((s, k), (s, e, KINDS[k])) for s, k, e, _ in base_spans(t)]
        base = [x[1] for x in want]
        for m in TOKEN.finditer(t):
            core = m[0].strip("+/_.=-")
            s = m.start() + m[0].index(core) if core else 0
            e = s + len(core)
            if len(core) < 6:
                continue
            gain = {k: g.by_kind[k].of([core])[0] - g.plain.of([core])[0] - MARGIN for k in sorted(g.by_kind)}
            k = max(gain, key=lambda k: gain[k])
            touch = [b for b in base if b[0] < e and b[1] > s]
            if gain[k] >= 0 and all(s <= b[0] and b[1] <= e and b[1] - b[0] < e - s for b in touch):
                want.append(((s, 3), (s, e, f"like_{KINDS[k]}")))
        want = [x for _, x in sorted(want)]
        if i < 1000:
            assert spans_of(got[i]) == want and got[i].n_inferred == sum(x[2].startswith("like_") for x in want)
        elif i == 1000:
            assert any(k.startswith("like_") and t[s:e].startswith("k_") for s, e, k in want)  # longer than the base span in it


def test_numbers_are_ordinary():
    """Phone and card numbers are no credentials, though a hexadecimal automaton could make them."""
    from blockweave.llm.secrets_scan import MARGIN, PLAIN, grammars

    r = random.Random(7)
    number = lambda: "-".join("".join(r.choice("0123456789") for _ in range(n)) for n in r.choice([(3, 4), (16,), (3, 3, 4)]))
    by = {2: {key(r, 2): 1.0 for _ in range(200)}, PLAIN: {w: 500.0 for w in WORDS} | {number(): 1.0 for _ in range(60)}}
    g = grammars(by)
    new = [number() for _ in range(50)]
    assert (g.by_kind[2].of(new) - g.plain.of(new) < MARGIN).all()
    assert (g.by_kind[2].of([key(r, 2)]) - g.plain.of([key(r, 2)]) > MARGIN).all()


def test_odd_rows(spark, found):
    from blockweave.llm.secrets_scan import scan_secrets

    g, _ = found
    text = planted()[2][1]
    rows = [(None, text, "x"), (None, text, "y"), (1, None, "z"), (2, "", None), (3, text * 50, None)]
    got = Counter((r.doc_id, r.n_inferred) for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"), g).collect())
    n = len([1 for *_, b in [planted()[2]] for _ in b])
    assert got == Counter([(None, n), (None, n), (1, 0), (2, 0), (3, 50 * n)])
    assert scan_secrets(spark.createDataFrame(rows[2:4], "doc_id long, text string, spans string")).count() == 2


def test_values_teach_whole():
    """Values of 4,096 characters that differ after the first 3,000 make automata that tell the difference."""
    from blockweave.llm.secrets_scan import infer

    head = "ab" * 1500
    x, y = ({head + tail * 1096: 1.0, head + tail * 1095 + tail: 1.0} for tail in ("7", "z"))
    a, b = infer(x, 0.8), infer(y, 0.8)
    assert a.of(list(x))[0] > b.of(list(x))[0] + 1000 and b.of(list(y))[0] > a.of(list(y))[0] + 1000


def test_executors_learn_what_the_driver_would(spark):
    from blockweave.llm.secrets_scan import PLAIN, grammars

    r = random.Random(8)
    by = {1: {key(r, 1): 1.0 for _ in range(60)}, PLAIN: {w: 5.0 for w in WORDS} | {"12-34": 1.0, "2020-01-01": 2.0}}
    here, there = grammars(by), grammars(by, spark)
    new = [key(r, 1), "traveller", "2021-02-03", "q" * 50]
    assert np.array_equal(here.by_kind[1].of(new), there.by_kind[1].of(new)) and np.array_equal(here.plain.of(new), there.plain.of(new))
