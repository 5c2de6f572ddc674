"""Whitening of embeddings from an exact covariance.

Entries are integers, so the covariance can be exact: vectors are centred at the
whole part of their mean, split into digits whose float64 products BLAS adds up
without rounding, put together as big integers in each task, and summed over the
tasks by Spark; what the fraction of the mean adds is taken off exactly. The
driver then has one matrix of the vectors' dimension, whatever the number of
rows, and finds its eigenvectors in fixed point with 120 bits, so that small
eigenvalues beside very large ones keep their digits.
"""

from __future__ import annotations

from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import bound_batches
from .vectors import bits, common_length, entries, product, usable

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this many are cut to it before the shift.
MOST = 1 << 61
TOP = 32
#: Rows multiplied at once.
BLOCK = 4096
#: Bits of one digit of a big integer between tasks and driver.
DIGIT = 40
#: Bits behind the point in which eigenvectors are found, and those below the largest eigenvalue at which one counts as zero.
POINT, RANK_BITS = 120, 90

#: Columns that whitening adds.
NEW = ("n_", "deviation_", "whitened_", "explained_", "identity_error_")


def _batches(column: int, d: int, scale: int, shift: int):
    """Of each Arrow batch (batch, integer matrix), a bounded number of rows at a time."""

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                yield part, entries(part.column(column), d, scale, shift, MOST)

    return each


def sums(rows: DataFrame, column: str, d: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int]]:
    """(number of rows, sum of each dimension), as Python's integers."""
    each = _batches(0, d, scale, shift)

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for _, x in each(batches):
            n += len(x)
            total += x.sum(axis=0) if bits(x) + 12 < 63 else x.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["j", "n", "s"])

    got = rows.select(f"`{column}`").mapInArrow(run, "j int, n long, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by = {r["j"]: r for r in got}
    return (int(by[0]["n"]), [int(by[j]["s"]) for j in range(d)]) if by else (0, [0] * d)


def _digits(m: np.ndarray) -> list[np.ndarray]:
    """Big integers as arrays of longs, the least digit first; the last carries the sign."""
    n = -(-(bits(m) + 1) // DIGIT)
    return [*(((m >> (DIGIT * k)) & ((1 << DIGIT) - 1)).astype(np.int64) for k in range(n - 1)), (m >> (DIGIT * (n - 1))).astype(np.int64)]


def moments(rows: DataFrame, column: str, d: int, centre: list[int], scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Sum over rows of (x - centre)(x - centre)', exactly. A task sends its upper triangle as digits, and the sums per cell are Spark's."""
    each = _batches(0, d, scale, shift)

    def run(batches):
        mid, total = np.array(centre, np.int64), None
        for _, x in each(batches):
            x = x - mid
            p = product(x.T, x).astype(object)
            total = p if total is None else total + p
        if total is not None:
            for k, m in enumerate(_digits(total)):
                yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([k] * d, pa.int32()), pa.array([m[i, i:] for i in range(d)], pa.list_(pa.int64()))], ["i", "k", "v"])

    parts = rows.select(f"`{column}`").mapInArrow(run, "i int, k int, v array<long>")
    cells = parts.select("i", "k", F.posexplode("v").alias("j", "v")).groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    out = np.zeros((d, d), object)
    for r in cells.collect():
        i, j = r["i"], r["i"] + r["j"]
        out[i, j] += int(r["v"]) << (DIGIT * r["k"])
    return np.triu(out) + np.triu(out, 1).T


def _rounded(a: np.ndarray, shift: int) -> np.ndarray:
    return (a + (1 << (shift - 1))) >> shift


def _fixed(a: np.ndarray) -> np.ndarray:
    return np.array([[int(np.ldexp(x, POINT)) for x in row] for row in a], object)


def eigen(c: np.ndarray, rounds: int = 40) -> tuple[list[int], np.ndarray]:
    """(eigenvalues times 2**POINT by falling value, unit eigenvectors as columns times 2**POINT) of a symmetric matrix of integers.

    The float64 eigenvectors are the start. Each round makes them orthonormal and
    the matrix diagonal to first order in fixed point; where two directions are
    too near for that, their block is solved by itself, relative to its own size.
    """
    d = len(c)
    top = max(bits(c), 1)
    small = np.array([[int(x) / (1 << top) for x in row] for row in c])
    x = _fixed(np.linalg.eigh(small)[1][:, ::-1])
    one = np.array([[int(i == j) << POINT for j in range(d)] for i in range(d)], object)
    wide = lambda a: a.astype(object)
    for _ in range(rounds):
        for _ in range(2):
            x = x + _rounded(wide(product(x, one - _rounded(wide(product(x.T, x)), POINT))), POINT + 1)
        z = _rounded(wide(product(x.T, wide(product(c.astype(object), x)))), POINT)  # times 2**POINT
        values = np.diag(z)
        gap = values[None, :] - values[:, None]
        off = np.abs(z - np.diag(values))
        floor = max(1, max(values) >> (POINT - 20))
        if not ((off > (np.abs(gap) >> 62)) & (off > floor)).any():
            break
        # near: pairs whose rotation is not small; each connected group of them is solved as a block
        near = (off * 20 > np.abs(gap)) & (off > floor)
        turn = np.eye(d)
        left = set(range(d))
        while left:
            group, todo = [], [left.pop()]
            while todo:
                i = todo.pop()
                group.append(i)
                todo += [j for j in np.flatnonzero(near[i]).tolist() if j in left]
                left.difference_update(todo)
            if len(group) > 1:
                at = np.ix_(sorted(group), sorted(group))
                block = z[at]
                most = max(bits(block), 1)
                turn[at] = np.linalg.eigh(np.array([[int(v) / (1 << most) for v in row] for row in block]))[1][:, ::-1]
        if near.any():
            x = _rounded(wide(product(x, _fixed(turn))), POINT)
        else:
            step = np.array([[(int(z[i, j]) << POINT) // int(gap[i, j]) if off[i, j] > floor else 0 for j in range(d)] for i in range(d)], object)
            x = x + _rounded(wide(product(x, step)), POINT)
    order = sorted(range(d), key=lambda i: -values[i])
    return [int(values[i]) for i in order], x[:, order]


def fit(rows: DataFrame, column: str, d: int, top: int = TOP, scale: int = SCALE, shift: int = SHIFT) -> dict | None:
    """The model of rows whose vectors all are usable and have d entries: n, S, the components, their eigenvalues and shares. None of no rows."""
    n, s = sums(rows, column, d, scale, shift)
    if not n:
        return None
    centre = [t // n for t in s]
    rest = np.array([t - n * m for t, m in zip(s, centre, strict=True)], object)
    c = n * moments(rows, column, d, centre, scale, shift) - np.outer(rest, rest)  # n**2 times the covariance
    trace = int(sum(c[i, i] for i in range(d)))
    values, x = eigen(c) if trace else ([], np.zeros((d, 0), object))
    kept = [i for i, v in enumerate(values[:top]) if v > 0 and v > values[0] >> RANK_BITS]
    vectors = np.array([[int(v) / (1 << POINT) for v in x[:, i]] for i in kept]).reshape(len(kept), d)
    vectors = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in vectors]).reshape(len(kept), d)
    return {
        "n": n,
        "sums": s,
        "centre": centre,
        "rest": [int(r) for r in rest],
        "vectors": vectors,
        "scales": [isqrt(values[i] << (2 * POINT)) / (n << POINT) / (1 << (POINT // 2)) for i in kept],  # square roots of the eigenvalues
        "explained": [values[i] / (trace << POINT) for i in kept],
    }


def _project(x: np.ndarray, model: dict) -> np.ndarray:
    y = (x - np.array(model["centre"], np.int64)).astype(np.float64) - np.array([r / model["n"] for r in model["rest"]])
    return y @ (model["vectors"] / np.array(model["scales"])[:, None]).T if len(model["scales"]) else np.zeros((len(x), 0))


def identity_error(rows: DataFrame, column: str, d: int, model: dict, scale: int = SCALE, shift: int = SHIFT) -> float:
    """The largest absolute entry of the whitened rows' covariance, as measured, minus the identity; 0 without components."""
    k, each = len(model["scales"]), _batches(0, d, scale, shift)
    if not k:
        return 0.0

    def means(batches):
        total = sum((_project(x, model).sum(axis=0) for _, x in each(batches)), np.zeros(k))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["i", "v"])

    sent = rows.select(f"`{column}`")
    mean = np.zeros(k)
    for r in sent.mapInArrow(means, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        mean[r["i"]] = r["v"] / model["n"]

    def squares(batches):
        total = np.zeros((k, k))
        for _, x in each(batches):
            w = _project(x, model) - mean
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    cells = sent.mapInArrow(squares, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    gap = F.abs(F.col("v") / model["n"] - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return float(cells.agg(F.max(gap)).head()[0])


def whiten(vectors: DataFrame, column: str = "embedding", top: int = TOP, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows that take part, with n_, deviation_ (decimal: sum over dimensions of (n x - S)**2, exact), whitened_ (array of doubles, one for each component), explained_ (their shares) and identity_error_.

    A row takes part if its vector is there, has as many entries as most vectors
    (of equally common lengths the greatest), and all entries are there and
    finite. Entries are floor(scale * c) + shift; scaled entries past 2**61 stop
    there. Components of no variance are left out: there is no scale to
    divide by, so equal vectors, or a single one, get none. deviation_ is null
    past 38 digits. Repeated rows and null ids count and stay, an empty table
    stays empty. Other columns pass as they are; one named as a new column gives
    way.
    """
    rows = vectors.drop(*NEW).where(usable(column))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("n_ long, deviation_ decimal(38,0), whitened_ array<double>, explained_ array<double>, identity_error_ double").fields])
    bound_batches(vectors.sparkSession)
    d = common_length(rows, column)
    model = None
    if d is not None:
        rows = rows.where(F.size(f"`{column}`") == d)
        model = fit(rows, column, d, top, scale, shift)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, column, d, model, scale, shift)
    each = _batches(rows.columns.index(column), d, scale, shift)

    def deviations(x: np.ndarray) -> pa.Array:
        y, rest, n = x - np.array(model["centre"], np.int64), np.array(model["rest"], object), model["n"]
        if 2 * bits(y) + d.bit_length() >= 62:
            y = y.astype(object)
        cross = y @ rest.astype(np.int64) if y.dtype == np.int64 and bits(y) + bits(rest) + d.bit_length() < 62 else y.astype(object) @ rest
        squares, own = (y * y).sum(axis=1), int((rest * rest).sum())
        out = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, cross, strict=True)]
        return pa.array([Decimal(v) if v < 10**38 else None for v in out], pa.decimal128(38, 0))

    def run(batches):
        for b, x in each(batches):
            w = _project(x, model)
            k = w.shape[1]
            lists = lambda flat, rows=len(x), k=k: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * k, pa.int32()), pa.array(flat, pa.float64()))
            more = [pa.array([model["n"]] * len(x), pa.int64()), deviations(x), lists(w.ravel()), lists(np.tile(model["explained"], len(x))), pa.array([error] * len(x), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    return rows.mapInArrow(run, schema)
