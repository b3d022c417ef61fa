"""Whitening against numpy in double precision and exact whole-number sums; refinement of clustered eigenvalues."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from gridsignal.llm import whitening
from gridsignal.llm.eigen import clusters, eigenvectors

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 5, "n") for i, v in vectors], SCHEMA).repartition(3)


def random_symmetric(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 100, 40), [5.0, 5.0, 5.0, 2.0, 1.0], [3.0, 3.0 + 1e-9, 3.0 + 2e-9, 1e-3, 0.0], np.geomspace(1e-12, 1, 20),
    [7.0], np.concatenate([1 + 1e-7 * np.arange(10), 2 + 1e-12 * np.arange(10)]), np.ones(6), 1e200 * np.arange(1.0, 5.0),
])
def test_eigenvectors_reach_double_precision(values):
    a = random_symmetric(values)
    a = (a + a.T) / 2
    found, x = eigenvectors(a)
    size = np.abs(a).max()
    assert np.all(np.diff(found) <= 0)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-13
    assert np.abs(a / size @ x - x * (found / size)).max() < 1e-13 * len(a)
    assert np.allclose(found, np.sort(np.linalg.eigvalsh(a / size) * size)[::-1], rtol=0, atol=size * 1e-13 * len(a))


def test_eigenvectors_beat_single_precision():
    a = random_symmetric(np.linspace(1, 2, 60))
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    _, x = eigenvectors(a)
    off = lambda v: np.abs(v.T @ a @ v - np.diag(np.diag(v.T @ a @ v))).max()
    assert off(single) > 1e-8 and off(x) < 1e-13
    assert np.array_equal(eigenvectors(np.zeros((3, 3)))[0], np.zeros(3))
    assert [sorted(c.tolist()) for c in clusters(np.array([1.0, 5.0, 1.1, 9.0, 5.05]), 0.2)] == [[0, 2], [1, 4]]


def by_hand(vectors, components=16):
    usable = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in usable}
    fit = sorted(set(map(tuple, x.values())))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, total)) for i, v in x.items()}
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, total)] for v in fit])
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    white = {i: (np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, total)]) @ q)[:components] / np.sqrt(values[:components]) for i, v in x.items()}
    return n, deviation, values / values.sum(), white


def check(spark, vectors):
    got = whitening.whiten(frame(spark, vectors)).collect()
    n, deviation, explained, white = by_hand(vectors)
    count = min(16, len(explained))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in white for c in range(1, count + 1))
    signs = {}
    for r in got:
        want = white[r.vec_id][r.component - 1]
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(bool(np.sign(want) == np.sign(r.whitened)))
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(abs(r.whitened) - abs(want)) < 1e-7
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_like_numpy(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20))
    vectors = [(i, (rng.normal(size=20) @ mix).astype(np.float32).tolist()) for i in range(400)]
    # copies of one vector, also a third of all rows, count once
    vectors += [(1000 + i, vectors[7][1]) for i in range(200)]
    vectors += [(2000, None), (2001, [None] + [1.0] * 19), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [])]
    check(spark, vectors)


def test_few_dimensions_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(50)]
    check(spark, vectors)
    longer = frame(spark, vectors + [(77, [1.0] * 5)])
    assert {r.vec_id for r in whitening.whiten(longer).select("vec_id").distinct().collect()} == set(range(50))


def test_equal_vectors_and_no_vectors(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 2.0]), (None, [0.5, 2.0])])).collect()
    assert len(got) == 4 and {r.vec_id for r in got} == {1, None}
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, None) for r in got)
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_dimension_and_huge_entries(spark):
    flat = whitening.whiten(frame(spark, [(i, [float(i), 1.0]) for i in range(10)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    huge = whitening.whiten(frame(spark, [(1, [1e38, 0.0]), (2, [-1e38, 0.0]), (3, [0.0, 1.0])])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id != 3} == {None}
    assert {r.n for r in huge} == {3}
