"""Substring dedup by sharded automata: hot phrases, one passage in very many documents, and what the automaton decides."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from blockweave.llm.substrings import _joined, _locate

from .test_llm import words


def expected(rows, window=50):
    data, first = [(d, words(t)) for d, t in rows], {}
    for d, w in data:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    want = Counter()
    for d, w in data:
        gone = {i + j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(window)}
        want[(d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    return want


def table():
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(n))
    line, passage, pool = say(30), say(75), [say(200) for _ in range(6)]
    out = []
    for i in range(150):
        kind = i % 5
        t = say(r.randrange(0, 120)) + "\n"
        t += {0: line + " \t" + say(60), 1: passage + "\n" + say(20), 2: r.choice(pool)[r.randrange(300) :], 3: say(40) + " " + line, 4: passage * (1 + i % 2)}[kind]
        out.append((i * 7 % 151, t))
    out += [(None, passage), (3, passage + " tail"), (3, passage + " tail"), (3, say(9)), (900, "x " * 400), (901, "x " * 60), (902, ""), (903, None)]
    return out


def test_result_is_the_same_whatever_is_hot(spark):
    from blockweave.llm.substrings import dedup_substrings

    rows = table()
    want = expected(rows)
    assert sum(k[2] > 0 for k in want) > 30
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (2, 20, 10_000):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(d, hot=hot).collect())
        assert got == want


def test_texts_come_back(spark):
    from blockweave.llm.substrings import dedup_substrings

    rows = table()[:60]
    d = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, at string, row_key string")
    for r in dedup_substrings(d, texts=True).collect():
        assert len(r.kept_text.split(" ")) == r.n_words - r.n_removed or r.kept_text == ""
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_the_automaton_locates(spark):
    """A shard without confirmed phrases finds nothing; with them, windows are compared by their words, not by the phrase."""
    from blockweave.llm.substrings import _joined, _locate

    r = random.Random(13)
    w = [f"w{r.randrange(10**6)}" for _ in range(60)]
    piece = lambda x: "".join(f"{y} " for y in x).encode()
    a, b = w, [*w[:20], *w[20:36], *["other"] * 24]  # the same phrase, other words after it
    blobs = [_joined([piece(a)], [5]), _joined([piece(b), piece(a[5:])], [3, 9])]
    sent = pa.table({"shard": pa.array([0, 0], pa.int32()), "part": pa.array([1, 2], pa.int64()), "blob": pa.array(blobs, pa.binary())})
    answers = lambda p: [memoryview(pa.decompress(x[8:], 8 * int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)).cast("q").tolist() for x in _locate(50, 16)(pa.table({"phrase": pa.array(p, pa.binary())}), sent).column("blob").to_pylist()]
    none = (1 << 63) - 1
    assert answers([]) == [[none] * 11, [none] * 17]
    first, second = answers([piece(w[20:36])])
    assert first == [5] * 11 and second == [3] * 11 + [5] * 6


def test_windows_of_a_hot_phrase_are_not_held_together():
    """A phrase in very many different passages: memory goes by the passages, not by all the windows around it."""
    r = random.Random(4)
    say = lambda n: b"".join(b"%06d " % r.randrange(10**6) for _ in range(n))
    hot = say(16)
    pieces = [say(34) + hot + say(34) for _ in range(2000)]
    pieces.append(pieces[7][7:])  # its first word apart
    sent = pa.table({"shard": pa.array([0], pa.int32()), "part": pa.array([5], pa.int64()), "blob": [_joined(pieces, [*range(10, 2010), 3])]})
    run = _locate(50, 16)
    tracemalloc.start()
    out = run(pa.table({"phrase": [hot]}), sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    blob = out.column("blob")[0].as_py()
    got = np.frombuffer(pa.decompress(blob[8:], 8 * int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), "<i8")
    want = np.concatenate([np.repeat(np.arange(10, 2010), 35), np.full(34, 3)])
    want[7 * 35 + 1 : 8 * 35] = 3
    assert (got == want).all() and peak < 16 << 20, peak
