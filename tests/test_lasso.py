"""The L1 optimum against a plain solver and its own conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplodeck.operators import lasso as ls

SCHEMA = "person_id long, ancestry string, label double, idx array<int>, dose array<double>"


def made(n=300, p=12, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.choice([0.0, 1.0, 2.0], (n, p), p=[0.6, 0.3, 0.1])
    x[:, 5] = 0  # never seen
    x[:, 6] = x[:, 7]  # the same twice
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 1.2 * x[:, 1] - 0.5)))).astype(float)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, "X", float(t), [int(j) for j in np.flatnonzero(r)], [float(r[j]) for j in np.flatnonzero(r)])
            for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(x, y, c, rounds=60_000):
    """Proximal gradient in small steps on dense arrays."""
    scale = x.std(0)
    scale[scale == 0] = 1
    a = np.c_[x / scale, np.ones(len(y))]
    theta, size = np.zeros(a.shape[1]), 4 / (c * np.linalg.norm(a, 2) ** 2)
    for _ in range(rounds):
        grad = c * a.T @ (1 / (1 + np.exp(-a @ theta)) - y)
        u = theta - size * grad
        theta = np.sign(u) * np.maximum(np.abs(u) - size, 0)
    return theta, c * a.T @ (1 / (1 + np.exp(-a @ theta)) - y), a


@pytest.mark.parametrize("c", [0.1, 1.0])
def test_equals_a_plain_solver(spark, c):
    x, y = made()
    fit = ls.solve(frame(spark, x, y), x.shape[1], c)
    theta, grad, a = plain(x, y, c)
    assert fit.violation <= ls.TOLERANCE and ls.violations(theta, grad).max() < 1e-9 and fit.passes < 40
    # two equal columns share a weight in any proportion, so predictions are compared, and the other weights
    own = np.append(fit.weights, fit.intercept)
    assert np.abs(a @ own - a @ theta).max() < 1e-6
    others = [j for j in range(len(theta)) if j not in (6, 7)]
    assert np.abs(own - theta)[others].max() < 1e-6 and own[5] == 0


def test_conditions_recomputed_from_tokens(spark):
    x, y = made(200, 8, 9)
    tokens = spark.createDataFrame(
        [(i, "X", float(t), [f"f{j}" for j in range(8) for _ in range(int(r[j]))]) for i, (r, t) in enumerate(zip(x, y))],
        "person_id long, ancestry string, label double, tokens array<string>")
    names = spark.createDataFrame([(j, f"f{j}") for j in range(8)], "index int, feature string")
    rows = ls.sparse_rows(tokens, names)
    assert sorted((r.person_id, tuple(r.idx), tuple(r.dose)) for r in rows.collect()) == [
        (i, tuple(np.flatnonzero(r)), tuple(r[np.flatnonzero(r)])) for i, r in enumerate(x)]
    table = ls.coefficients(rows, names, 1.0)
    got = ls.optimality(tokens, names, table, 1.0).collect()
    assert len(got) == 9 and max(r.violation for r in got) < 1e-6
    worse = table.withColumn("coefficient", F.when(F.col("feature") == "f0", 0.0).otherwise(F.col("coefficient")))
    assert max(r.violation for r in ls.optimality(tokens, names, worse, 1.0).collect()) > 0.1


def test_scores_of_held_out_people(spark):
    x, y = made(240)
    df = frame(spark, x, y).withColumn("fold", (F.col("person_id") % 3).cast("int"))
    got = {r.person_id: r.score for r in ls.out_of_fold_scores(df, x.shape[1], 3, 1.0).collect()}
    fold = np.arange(240) % 3
    for k in range(3):
        theta, _, _ = plain(x[fold != k], y[fold != k], 1.0, 20_000)
        scale = x[fold != k].std(0)
        scale[scale == 0] = 1
        want = 1 / (1 + np.exp(-(x[fold == k] / scale @ theta[:-1] + theta[-1])))
        assert np.abs(np.array([got[i] for i in np.flatnonzero(fold == k)]) - want).max() < 1e-4
