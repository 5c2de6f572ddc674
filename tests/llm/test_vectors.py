"""Whitening and hard negatives against exact plain computations."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import negatives, whitening
from blockweave.llm.vectors import product

SCHEMA = "vec_id long, embedding array<float>, label int, n_ string, id_ string, v_ int"
SF = "/root/testdata/sf0.001"


def rows(n=350, d=6, seed=3, spread=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (1 if spread is None else spread)
    out = [(i, [float(v) for v in x[i]], int(r.integers(0, 4)), "a", None, 1) for i in range(n)]
    for i in range(5, 90):  # a hot vector
        out[i] = (i, out[4][1], out[i][2], "b", None, 2)
    out += [out[100], out[100], out[0], (None, out[3][1], 1, None, None, None), (None, None, None, None, None, None)]
    nan, inf, ok = float("nan"), float("inf"), [1.0] * (d - 1)
    out += [(1000, None, 1, "", "", 1), (1100, [nan, *ok], 1, "", "", 1), (1200, [inf, *ok], 1, "", "", 1), (1300, [None, *ok], 1, "", "", 1), (1400, [], 1, "", "", 1), (1500, ok, 1, "", "", 1), (1600, out[7][1], None, "", "", 1)]
    return out


def usable(data, d):
    return [r for r in data if r[1] is not None and len(r[1]) == d and all(v is not None and math.isfinite(v) for v in r[1])]


def whole(v, scale, shift=0):
    return math.floor(scale * float(np.float32(v))) + shift


def test_products_are_exact():
    r = np.random.default_rng(1)
    for wide in (3, 20, 40, 62):
        a, b = r.integers(-(2**wide), 2**wide, (5, 300)), r.integers(-(2**wide), 2**wide, (300, 4))
        assert (product(a, b).astype(object) == a.astype(object) @ b.astype(object)).all()
    huge = np.array([[1 << 200, -3], [5, -(1 << 150)]], object)
    assert (product(huge, huge) == huge @ huge).all()


@pytest.mark.parametrize("spread", [None, [1.0, 1e-1, 1e3, 1e5, 1.0, 1e7]])
def test_whitening_against_exact_covariance(spark, spread):
    data = rows(spread=spread)
    got = whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(3), top=4).collect()
    good = usable(data, 6)
    x = np.array([[whole(v, 64, 1_000_000) for v in r[1]] for r in good], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    assert len(got) == n and {r["n_"] for r in got} == {n}
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), int(r["deviation_"])) for r in got) == sorted(((g[0] is None, g[0] or 0), int(v)) for g, v in zip(good, (y * y).sum(axis=1), strict=True))
    cov = [[Fraction(int(v), n**3) for v in row] for row in y.T @ y]
    w = np.array([r["whitened_"] for r in got])
    assert w.shape == (n, 4) and np.abs(w.T @ w / n - np.eye(4)).max() < 1e-6 and 0 <= got[0]["identity_error_"] < 1e-6
    # A component's values are the centred vectors on one unit direction: V u = e u for the direction they give back.
    centred = {}
    for g, v in zip(good, y, strict=True):
        centred.setdefault(tuple(float(np.float32(c)) for c in g[1]), v)
    yy = np.array([[float(v) / n for v in centred[tuple(r["embedding"])]] for r in got])
    trace = sum(cov[i][i] for i in range(6))
    v = np.array([[float(c) for c in row] for row in cov])
    for k in range(4):
        u = yy.T @ w[:, k] / n  # V u_k / sqrt(e) = sqrt(e) u_k
        e = float(u @ u)
        assert abs(got[0]["explained_"][k] / (e / float(trace)) - 1) < 1e-4
        assert np.abs(v @ u - e * u).max() <= 1e-9 * np.abs(v).max() * np.abs(u).max()
    assert got[0]["explained_"] == sorted(got[0]["explained_"], reverse=True)


def test_eigenvalues_of_graded_and_singular_matrices():
    r = np.random.default_rng(2)
    for m in (np.diag([10**30, 10**12, 7, 7, 0]), np.ones((5, 5)), np.zeros((5, 5))):
        a = r.integers(-3, 4, (5, 5)).astype(object)
        c = a.T @ np.array([[int(v) for v in row] for row in m], object) @ a
        values, x = whitening.eigen(c)
        z = x.T @ c @ x
        for i in range(5):
            for j in range(5):
                if i != j and min(z[i, i], z[j, j]) > (max(np.diag(z)) >> whitening.RANK_BITS):
                    assert Fraction(int(z[i, j]) ** 2, int(z[i, i]) * int(z[j, j])) < Fraction(1, 10**20)
        assert abs(sum(values) - (int(sum(np.diag(c))) << whitening.POINT)) <= max(values + [1]) >> 90 or not any(values)


def test_whitening_of_few_rows(spark):
    make = lambda data: whitening.whiten(spark.createDataFrame(data, SCHEMA))
    assert make([]).count() == 0 and make([(1, None, 1, "", "", 1)]).count() == 0
    one = make([(1, [1.0, 2.0], 1, "", "", 1)] * 3).collect()
    assert [(r["n_"], int(r["deviation_"]), r["whitened_"], r["identity_error_"]) for r in one] == [(3, 0, [], 0.0)] * 3
    huge = make([(1, [3e38, 2.0], 1, "", "", 1), (2, [-3e38, 1.0], 1, "", "", 1)]).collect()
    assert len(huge) == 2 and all(len(r["whitened_"]) == 1 and abs(abs(r["whitened_"][0]) - 1) < 1e-9 for r in huge)
    assert make(rows()).columns == ["vec_id", "embedding", "label", "id_", "v_", *whitening.NEW]


def test_whitening_query(spark):
    from blockweave.llm.queries import op11_whitening

    got = op11_whitening(spark, SF).toPandas()
    n = got["vec_id"].nunique()
    assert len(got) == 32 * n and set(got["component"]) == set(range(1, 33)) and got["identity_error"].max() < 1e-6
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-6


def plain_negatives(data, d, scale=256, five=5, ten=10):
    good = [r for r in usable(data, d) if r[2] is not None]
    x = [[whole(v, scale) for v in r[1]] for r in good]
    out = []
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for i, a in enumerate(good):
        if a[0] is None or a[0] % 100:
            continue
        scores = [(sum(p * q for p, q in zip(x[i], x[j], strict=True)), b[0], b[2], j) for j, b in enumerate(good) if j != i]
        for s, pid, _, _ in sorted((p for p in scores if p[2] == a[2]), key=order)[:five]:
            band = sorted((p for p in scores if p[2] != a[2] and 30 * s <= 100 * p[0] <= 90 * s), key=order)[:ten]
            out += [(a[0], pid, k + 1, p[1], s, p[0]) for k, p in enumerate(band)]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,tile,block,sample", [(8192, 512, 16384, 4096), (16, 2, 2, 8)])
def test_negatives_against_all_pairs(spark, monkeypatch, chunk, tile, block, sample):
    for name, value in (("CHUNK", chunk), ("TILE", tile), ("BLOCK", block), ("SAMPLE", sample)):
        monkeypatch.setattr(negatives, name, value)
    data = rows(n=420)
    got = negatives.mine(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(data, 6)


def test_negatives_of_large_entries_and_few_rows(spark):
    data = [(i * 50, [float(2**15 * ((i * 7) % 11 - 3)), float(i)], i % 2, "", "", 1) for i in range(40)]
    got = negatives.mine(spark.createDataFrame(data, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(data, 2) != []
    for few in ([], data[:1], [(100, [1.0], 1, "", "", 1), (100, [1.0], 1, "", "", 1)], [(1, [1.0], 1, "", "", 1)], [(0, [0.0, 0.0], 1, "", "", 1), (1, [0.0, 0.0], 1, "", "", 1), (2, [0.0, 0.0], 2, "", "", 1)]):
        got = negatives.mine(spark.createDataFrame(few, SCHEMA))
        assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(few, len(few[0][1]) if few else 0)


def test_brackets_skip_cells_that_cannot_matter(spark):
    """Two far groups: rows of the other group are not scored once the bounds stand."""
    r = np.random.default_rng(5)
    a = np.concatenate([r.integers(90, 110, (500, 4)), r.integers(-110, -90, (500, 4))])
    pivots = negatives.Pivots(a, int((a * a).sum(axis=1).max()), 4)
    all_ = negatives.Rows(a, np.arange(1000), np.zeros(1000, np.int64), np.arange(1000))
    search = negatives.Search(all_.at(np.arange(3)), pivots, None, None, 5)
    search.chunk(all_.at(np.arange(500)), pivots.of_rows(a[:500]))
    before = search.bound.copy()
    assert search._cell(slice(0, 3), all_, pivots.of_rows(a), a.astype(float), 0, np.arange(500, 1000), (pivots.of_rows(a[500:]).min(axis=0), pivots.of_rows(a[500:]).max(axis=0))) is None
    assert (before > 0).all()
