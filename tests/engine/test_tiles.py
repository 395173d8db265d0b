"""Products and estimator sums by tiles: against NumPy, and without shuffled products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import matrices as mx
from skyframe.plans.catalog import QUERIES
from tests.conftest import SF

SUMS = ["quad_estimator", "bias_term", "fisher"]
PASSES = ["window_rows_unity", "param_cov_2x2", "mixing_inverse_2x2", "mixing_identity_estimate"]
ENTRIES = ["matmul", "project_btsb"]


def table(spark, a, keep=None):
    keep = np.ones(a.shape, bool) if keep is None else keep
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(keep), strict=True)], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        assert out[r["i"], r["j"]] == 0
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.mark.parametrize("name", [*SUMS, *ENTRIES])
def test_nothing_of_the_size_of_the_product_is_shuffled(spark, name):
    """Before, partial products met by groups and derivatives by sort-merge joins."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "SortMergeJoin" not in plan


def test_the_residual_is_not_grouped_by_entry(spark):
    """Before, all its rows were grouped by (i, j); now only the modes are joined, by i."""
    plan = QUERIES["residual_matrix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "keys=[i#" not in plan


@pytest.mark.parametrize("name", PASSES)
def test_one_pass_for_all_sums(spark, name, monkeypatch):
    """Before, the Fisher matrix, the quadratic estimates and the bias were three queries, each with its own product."""
    calls, sums = [], mx._sums
    monkeypatch.setattr(mx, "_sums", lambda *a, **b: calls.append(b) or sums(*a, **b))
    QUERIES[name](spark, SF).collect()
    assert len(calls) == 1 and set(calls[0]) == {"fisher", "y", "params"}


@pytest.mark.parametrize("size", [3, 4, 100])
def test_products_with_holes(spark, size):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((10, 6)), rng.standard_normal((7, 6))
    ka, kb = rng.random(a.shape) < 0.3, rng.random(b.shape) < 0.3
    got = mx.multiply(table(spark, a, ka), table(spark, b, kb), right="T", size=size)
    there = (ka.astype(int) @ kb.T.astype(int)) > 0
    assert np.allclose(dense(got, (10, 7)), (a * ka) @ (b * kb).T) and got.count() == there.sum()


def test_long_inner_sides_go_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((5, 9)), rng.standard_normal((9, 4))
    monkeypatch.setattr(mx, "WIDE", 4)
    assert mx.project_tiles(table(spark, a).withColumnRenamed("j", "a"), table(spark, b)) is None
    assert np.allclose(dense(mx.multiply(table(spark, a), table(spark, b), size=2), (5, 4)), a @ b)


def test_estimator_sums(spark):
    """Tiles and packed rows give the same; a mode without an eigenvalue or amplitude counts for nothing."""
    rng = np.random.default_rng(3)
    n, cells = 11, 5
    modes, s = rng.standard_normal((n, cells)), rng.standard_normal((cells, cells))
    s = s + s.T
    lam, y, p = rng.random(n) + 0.5, rng.standard_normal(n), [0.5, 1.5]
    whole = modes @ s @ modes.T
    d = [whole, 2 * whole + np.eye(n)]
    lam[n - 1] = np.inf  # no eigenvalue: none of the last row
    ci = np.diag(1 / (1 + lam))
    evals = spark.createDataFrame([(i, float(lam[i])) for i in range(n - 1)], "i long, lambda double")
    amplitudes = spark.createDataFrame([(i, float(y[i])) for i in range(1, n)], "i long, y double")
    y[0] = 0
    params = spark.createDataFrame(list(enumerate(p)), "m long, p double")
    rest = np.diag(np.where(np.isinf(lam), 0, 1 + lam)) - p[0] * d[0] - p[1] * d[1]
    tiles = mx.project_tiles(table(spark, modes).withColumnRenamed("j", "a"), table(spark, s), size=4).split(lambda v, same: [v, 2 * v + same])
    assert np.allclose(dense(mx.residual(evals, tiles, params), (n, n)), np.triu(rest))
    rows = spark.createDataFrame([(m, i, j, float(d[m][i, j])) for m in range(2) for i in range(n) for j in range(i, n)], "m long, i long, j long, v double")
    for derivs in (tiles, rows):
        f, q, b = mx.parameters(derivs, evals, amplitudes, params, 2)
        assert np.allclose(f, [[np.trace(ci @ x @ ci @ z) / 2 for z in d] for x in d])
        assert np.allclose(q, [y @ ci @ x @ ci @ y / 2 for x in d])
        assert np.allclose(b, [np.trace(ci @ x @ ci @ rest) / 2 for x in d])
        assert np.allclose([r["b"] for r in mx.bias_of_residual(derivs, evals, params).orderBy("m").collect()], b)
    old = mx.bias(rows, evals, mx.residual(evals, rows, params))
    assert np.allclose([r["b"] for r in old.orderBy("m").collect()], b)


def test_residual_keeps_modes_without_a_derivative(spark):
    evals = spark.createDataFrame([(i, 1.0) for i in range(6)], "i long, lambda double")
    modes = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "i long, a long, v double")
    tiles = mx.project_tiles(modes, spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double"), size=2).split(lambda v, same: [v])
    got = {(r["i"], r["j"]): r["v"] for r in mx.residual(evals, tiles, spark.createDataFrame([(0, 1.0)], "m long, p double")).collect()}
    assert got == {(0, 0): 1.0, (0, 1): -2.0, (1, 1): -2.0, **{(i, i): 2.0 for i in range(2, 6)}}
