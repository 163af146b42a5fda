"""Whitening against plain numpy over whole tables and exact whole numbers."""

import math

import numpy as np
import pytest

from revscope.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, v string, data string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = x - sums / n
    v = centred.T @ centred / n
    e, vectors_ = np.linalg.eigh(v)
    return n, deviation, e[::-1], centred @ vectors_[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), np.trace(v)


@pytest.mark.parametrize("dimensions", [5, 32, 70])
def test_equals_brute_force(spark, dimensions, monkeypatch):
    monkeypatch.setattr(W, "ROWS", 64)
    rng = np.random.default_rng(dimensions)
    vectors = rng.normal(size=(500, dimensions)) * np.linspace(3, 1, dimensions) + rng.normal(size=dimensions)
    vectors = vectors.astype(np.float32)
    n, deviation, e, whitened, trace = brute(vectors)
    rows = W.whiten(table(spark, vectors.tolist())).collect()
    k = min(8, dimensions)
    assert len(rows) == 500 * k and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert all(r.deviation == deviation[r.vec_id] for r in rows) and rows[0].identity_error < 1e-9
    got = np.zeros((500, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-10)
    signs = np.sign((got * whitened[:, :k]).sum(axis=0))
    assert np.abs(got * signs - whitened[:, :k]).max() < 1e-7


def test_rows_that_take_no_part(spark):
    good = [[1.0, 2.0, 0.5], [0.0, 1.5, 2.5], [3.0, -1.0, 0.25], [1.0, 2.0, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [2.0**31, 0.0, 0.0]]
    rows = W.whiten(table(spark, good + bad, [7, None, 7, 3, *range(20, 27)])).collect()
    assert len(rows) == 12 and {r.n for r in rows} == {4}
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows if r.component == 1) == [(False, 3), (False, 7), (False, 7), (True, 0)]
    n, deviation, *_ = brute(good)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviation)


def test_no_variance_and_one_row(spark):
    same = W.whiten(table(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and all(r.whitened == 0 and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    flat = W.whiten(table(spark, [[float(i), 2.0, 0.0] for i in range(6)])).collect()
    assert {r.component: r.explained > 0 for r in flat} == {1: True, 2: False, 3: False} and flat[0].identity_error < 1e-9
    assert all(r.whitened == 0 for r in flat if r.component > 1)


def test_empty_tables(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [None, []])).collect() == []
    assert [f"{n} {t}" for n, t in W.whiten(table(spark, [])).dtypes] == [s.replace("long", "bigint") for s in W.RESULT.split(", ")]


def test_large_means_and_deviations_stay_exact(spark):
    vectors = [[2.0**29 + i, float(i % 3)] for i in range(40)]
    n, deviation, e, *_ = brute(vectors)
    rows = W.whiten(table(spark, vectors)).collect()
    assert all(r.deviation == deviation[r.vec_id] for r in rows) and rows[0].identity_error < 1e-9
    wide = W.whiten(table(spark, [[2.0**29], [-(2.0**29)]] * 2)).collect()
    assert {r.deviation for r in wide} == {None} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in wide)


def test_many_tiles_are_given_away_early(spark, monkeypatch):
    monkeypatch.setattr(W, "HELD", 1)
    vectors = np.random.default_rng(1).normal(size=(100, 40)).astype(np.float32)
    model = W.fit(table(spark, vectors.tolist()))
    assert np.allclose(model.eigenvalues, brute(vectors)[2][:8], rtol=1e-10)
