import math

import numpy as np
import pytest

from haplodeck.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def x_of(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]


def check(got, ids, vectors, most=8):
    """All columns against integers and numpy's symmetric eigensolver."""
    x = x_of(vectors)
    n, dims = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dims)]
    z = np.array([[(n * r[j] - sums[j]) / n for j in range(dims)] for r in x])
    v = z.T @ z / n
    values, unit = np.linalg.eigh(v)
    values, unit = values[::-1], unit[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == len(got) == n * k
    w = np.array([[rows[i, c + 1].whitened for c in range(k)] for i in ids])
    want = z @ unit[:, :k] / np.sqrt(values[:k])
    want *= np.sign((w * want).sum(0))
    assert np.abs(w - want).max() < 1e-6
    assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-7
    for at, i in enumerate(ids):
        for c in range(k):
            r = rows[i, c + 1]
            assert r.n == n and r.deviation == sum((n * x[at][j] - sums[j]) ** 2 for j in range(dims))
            assert r.deviation_digits == str(r.deviation)
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-7) and r.identity_error < 1e-7


def test_whole_table_against_numpy(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    got = queries.QUERIES["op12_whitening"](spark, data).collect()
    check(got, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_nulls_odd_lengths_repeats_and_low_rank(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (60, 3)) @ rng.normal(0, 1, (3, 5))
    vectors = [list(map(float, np.float32(v))) for v in base]
    vectors += vectors[:7]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    odd = [(900, None, "x"), (901, [1.0, None, 1.0, 1.0, 1.0], "x"), (902, [1.0, float("nan"), 0.0, 0.0, 0.0], "x"),
           (903, [float("inf")] * 5, "x"), (904, [1.0, 2.0], "x"), (905, [], "x"), (906, [3e38] * 5, "x")]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    got = whitening.whitened(df).collect()
    assert {r.vec_id for r in got} == {i for i, _, _ in rows}
    check(got, [i for i, _, _ in rows], vectors)


def test_repeated_and_null_ids_stay(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (None, [3.0, 1.0], "a")], SCHEMA)
    got = whitening.whitened(df).collect()
    assert len(got) == 6 and sum(r.vec_id is None for r in got) == 2


def test_no_variance_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], "a") for i in range(3)], SCHEMA)
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, "a"), (2, [], "b")], SCHEMA)).columns[:3] == [
        "vec_id", "component", "n"]


def test_factor_and_rotation_keep_small_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = 10.0 ** -np.arange(12)
    a = q * values @ q.T
    factor = whitening.pivoted_cholesky(a)
    assert np.abs(factor @ factor.T - a).max() < 1e-14
    found, unit = whitening.one_sided_jacobi(factor)
    assert np.abs(found[:10] / values[:10] - 1).max() < 1e-4
    assert np.abs(unit.T @ unit - np.eye(unit.shape[1])).max() < 1e-12
    rank = whitening.pivoted_cholesky(np.ones((6, 6)))
    assert rank.shape == (6, 1) and len(whitening.one_sided_jacobi(np.zeros((4, 0)))[0]) == 0


def test_deviation_beyond_64_bits_is_exact():
    model = whitening.Model(2, 1 << 40, [0, 0], 1 << 30)
    x = np.array([[1 << 30, 3]])
    assert model.deviation(x) == [(1 << 140) + 9 * (1 << 80)]
