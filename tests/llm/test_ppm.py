"""Memory of LM scoring's kernels, and that cuts into pieces change nothing."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from blockweave.llm import ppm


def batch(lens, seed=5):
    """Folded bytes of texts of so many bytes, made of few words, and their offsets."""
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 123, n)) for n in rng.integers(2, 9, 300)]
    offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    data = b" ".join(words[i] for i in rng.integers(0, 300, offs[-1] // 3 + 1))
    return np.frombuffer(data[: offs[-1]], np.uint8), offs


def peak(fn):
    """Most bytes of arrays that were held at once."""
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def column(kind, items):
    return pa.chunked_array([pa.array(items, kind)])


@pytest.mark.parametrize("lens", [[2000] * 1500, [3_000_000]])
def test_op8_batch_is_scored_in_few_bytes_a_byte(lens):
    data, offs = batch(lens)
    strings = {bytes(data[max(i - 5, a) : i + 1]) for a, b in zip(offs[:-1], offs[1:], strict=True) for i in range(a, b)}
    ends = {bytes(data[max(b - 5, a) : b]) for a, b in zip(offs[:-1], offs[1:], strict=True)}
    n_strings = len(strings) + len(ends)  # shorter strings stand at a text's begin
    n_words = len({w for a, b in zip(offs[:-1], offs[1:], strict=True) for w in bytes(data[a:b]).split()})
    lens, no = np.array(lens), np.zeros(len(lens), np.int64)
    docs = ppm._squeeze((np.arange(len(lens)), 8), (no, 1), (no, 1), (no, 5), (lens, 5)) + ppm._squeeze((data.astype(np.int64), 1))
    blobs = [docs, ppm._squeeze((np.zeros(n_words, np.int64), 6)), np.full(n_strings, -1, "<f4").tobytes()]
    table = pa.table({"kind": column(pa.int32(), [1, 3, 4]), "frag": column(pa.int32(), [None, 0, 0]), "part": column(pa.int64(), [0, 0, 0]), "blob": column(pa.binary(), blobs)})
    got = []
    assert peak(lambda: got.append(ppm._gather(table, 1, np.zeros(256)))) < 40 * len(data)
    assert got[0].column("score").to_pylist() == [-(n + 1.0) for n in lens]


def test_op8_hot_fragment_reads_its_batches_one_by_one():
    """A context that every batch has: what is held follows from its strings, not from the number of batches."""
    rng = np.random.default_rng(6)
    k = np.unique(sum(rng.integers(97, 105, 20_000) << (8 * j) for j in range(6)))
    low = ppm.Low(*ppm._added(k & 0xFFFFFF, np.ones(len(k), np.int64)))
    blob = ppm._squeeze((k, 6), (np.ones(len(k), np.int64), 4))
    got = []

    def run():
        for x in ppm._strings([blob] * 200, low):
            got[:] = [*got[:1], x]

    assert peak(run) < 120e6  # the strings of all batches, as numbers, take 56 MB, their counts as much
    assert got[0] == got[1] and np.allclose(np.frombuffer(got[0], "<f4"), ppm.Deep(low, k, np.full(len(k), 200)).logs(k), atol=1e-6)


@pytest.mark.parametrize("piece", [7, 50, 1 << 20])
@pytest.mark.parametrize("lens", [[0], [0, 0, 3], [1], [300, 0, 5, 43, 44, 45, 2], [12] * 40, [2000]])
def test_op8_pieces_hold_every_string(monkeypatch, piece, lens):
    monkeypatch.setattr(ppm, "PIECE", piece)
    data, offs = batch(lens)
    train = np.arange(len(lens)) % 3 != 1
    number = lambda s: int.from_bytes(s, "big")
    texts = [b"A" * 5 + bytes(data[a:b]) + b"A" for a, b in zip(offs[:-1], offs[1:], strict=True)]
    each = [[number(t[i - 5 : i + 1]) for i in range(5, len(t))] for t in texts]
    want = Counter(k for t, keys in zip(train, each, strict=True) if t for k in keys)
    k, n = ppm.strings_of(data, offs, train)
    assert k.tolist() == sorted({x for keys in each for x in keys}) and n.tolist() == [want[x] for x in k.tolist()]
    value = lambda keys: np.sqrt(keys % 1009)
    assert np.allclose(ppm.scores_of(data, offs, value), [value(np.array(keys)).sum() for keys in each])
    h, doc = ppm._words(data, offs)
    assert len(set(h.tolist())) == len({w for t in texts for w in t.strip(b"A").split()}) and np.bincount(doc, minlength=len(lens)).tolist() == [len(t.strip(b"A").split()) for t in texts]
