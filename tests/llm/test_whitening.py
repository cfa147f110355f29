"""The singular value solver, and whitening against a covariance and its eigenvectors."""

import math

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidemark.llm import bidiagonal, registry, whitening


def matrices():
    rng = np.random.default_rng(0)
    turned = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    yield rng.normal(size=(300, 64))
    yield rng.normal(size=(200, 30)) * np.geomspace(1, 1e-9, 30)
    yield rng.normal(size=(200, 30)) * np.geomspace(1e-9, 1, 30)
    yield rng.normal(size=(200, 5)) @ rng.normal(size=(5, 20))
    yield (turned(40) * np.repeat([3, 2, 1, 1e-3], 10)) @ turned(40)
    yield np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0) + 11) + np.eye(21, k=1) + np.eye(21, k=-1)).T  # pairs that nearly agree
    yield rng.normal(size=(30, 10)) * (np.arange(10) != 4)
    yield np.eye(12)
    yield np.zeros((4, 4))
    yield np.array([[2.0]])


@pytest.mark.parametrize("a", list(matrices()))
def test_singular(a):
    r = np.linalg.qr(np.vstack([a, np.zeros((a.shape[1], a.shape[1]))]), mode="r")
    values, v = bidiagonal.singular(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(len(r))).max() < 1e-11 and np.abs(r.T @ (r @ v) - v * values).max() <= 1e-13 * top


def test_bidiagonal_values_are_accurate_relative_to_themselves():
    main, upper = np.array([1.0, 1e-6, 1e-12]), np.array([1e-3, 1e-9])
    want = np.linalg.eigvalsh([[1 + 0.0]])[0]
    got = bidiagonal.dqds(main, upper)
    assert got[0] == pytest.approx(want + 1e-6, rel=1e-9) and np.prod(np.sqrt(got)) == pytest.approx(1e-18, rel=1e-13)


def slow_whitening(rows, components=16):
    x = {k: [math.floor(64 * float(c)) + 1000000 for c in v] for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))))
    n, sums = len(fit), fit.sum(axis=0)
    near = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(near.T @ near / n)
    order = np.argsort(-values)[:components]
    out = []
    for k, v in x.items():
        exact = n * np.array(v) - sums
        for c, o in enumerate(order):
            out.append((rows[k][0], c + 1, n, int((exact**2).sum()), (exact / n) @ vectors[:, o] / math.sqrt(values[o]), values[o] / values.sum()))
    return sorted(out, key=str)


def same(got, want, keys=4):
    got = sorted(map(tuple, got), key=str)
    assert [r[:keys] for r in got] == [r[:keys] for r in want]
    signs = {}
    for a, b in zip(got, want, strict=True):
        sign = signs.setdefault(a[1], 1 if abs(b[4]) < 1e-6 or a[4] * b[4] > 0 else -1)
        assert a[4] * sign == pytest.approx(b[4], abs=1e-7) and a[5] == pytest.approx(b[5], rel=1e-10) and a[6] < 1e-9


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = registry.queries()["op12_qd_whitening"](spark, DATA)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), slow_whitening(rows))


def test_edges(spark):
    rng = np.random.default_rng(4)
    good = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5])]
    rows = [*good, (5, good[5][1]), (None, good[7][1]), (400, None), (401, []), (402, [1.0, None, 0, 0, 0, 0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [-0.0] * 6), (406, [0.0] * 6)]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    odd = [(407, [1.0, 2.0]), (408, [1.0] * 7)]
    made = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "n", "part", "factor", "component", "size")})
    same(whitening.whiten(made.repartition(40)).collect(), slow_whitening(rows))
    flat = made.where("vec_id IN (405, 406)")
    assert whitening.whiten(flat).collect() == [] and whitening.whiten(made.where("false")).columns == whitening.whiten(made.where("vec_id < 9")).columns
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))


def test_deviation_beyond_long():
    exact = np.array([[3_000_000_000, 4], [2**32, 2**32]])
    assert whitening.deviations(exact) == [9 * 10**18 + 16, None]
