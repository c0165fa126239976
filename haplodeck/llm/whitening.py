"""Whitening of embedding vectors: principal components of the quantised entries, in four passes.

An entry c becomes the integer x = floor(1024 c) + 100000. The first pass sums x per dimension, exactly;
the second sums the products of entries that were centred first. What reaches the driver is one
triangle of dimensions x dimensions, whatever the number of rows. There the centred scatter is factored
by a pivoted Cholesky decomposition, which stops at the numerical rank, and one-sided Jacobi rotations
make the columns of the triangular factor orthogonal: their squared norms are the eigenvalues, the
columns divided by their norms the components. The scatter is never formed again, so small eigenvalues
keep their digits. The third pass projects every row and measures the covariance of the result, the
fourth returns the rows.

Rows without a vector, with null or non-finite entries, or with an entry too large for x to fit 53 bits
take no part and return no rows. So do vectors of another length than most have (on a tie the
shorter), and empty ones. Repeated rows count as often as they occur; a null id stays. Directions
without variance have no component, so fewer than `components` rows a vector come back for data of
lower rank, none for a table whose vectors are all equal or for an empty table. Of equal eigenvalues
any basis is right; the sign makes the largest entry of a component positive. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows centred and multiplied at a time.
BLOCK = 4096
_LOW = np.int64(0xFFFFFFFF)
_MOST = 1 << 53


def quantised(vectors: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a usable vector of that size, their entries x as int64)."""
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    length = np.asarray(vectors.value_lengths().fill_null(0))
    keep = valid & (length == size)
    rows = np.flatnonzero(keep)
    if not len(rows) or not size:
        return rows[:0], np.zeros((0, size or 0), np.int64)
    values = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
    c = np.asarray(values).reshape(len(rows), size)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(c * SCALE)
        good = (np.isfinite(x) & (np.abs(x) < _MOST)).all(axis=1)
    return rows[good], x[good].astype(np.int64) + SHIFT


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Rows of `a` against rank: a factor f with f @ f.T = a. Row by row in pivot order f is lower
    triangular; it stops where what is left of the diagonal is rounding error."""
    n = len(a)
    left, factor = np.diag(a).astype(float).copy(), np.zeros((n, n))
    least = n * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    done = np.zeros(n, bool)
    for k in range(n):
        p = int(np.where(done, -np.inf, left).argmax())
        if left[p] <= least:
            return factor[:, :k]
        factor[p, k] = np.sqrt(left[p])
        done[p] = True
        rest = ~done
        factor[rest, k] = (a[rest, p] - factor[rest, :k] @ factor[p, :k]) / factor[p, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as columns) of factor @ factor.T. Rotations of column pairs
    until all are orthogonal; the pairs of a round are disjoint and turn together."""
    a = factor.copy()
    n = a.shape[1]
    players = list(range(n)) + [None] * (n % 2)
    half = len(players) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(players) - 1, 0)):
            pairs = [(players[i], players[-1 - i]) for i in range(half)]
            pairs = np.array([(min(p), max(p)) for p in pairs if None not in p], int).reshape(-1, 2)
            left, right = a[:, pairs[:, 0]], a[:, pairs[:, 1]]
            alpha, beta, gamma = (left ** 2).sum(0), (right ** 2).sum(0), (left * right).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            zeta = (beta - alpha)[turn] / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            l, r = left[:, turn], right[:, turn]
            a[:, pairs[turn, 0]], a[:, pairs[turn, 1]] = c * l - c * t * r, c * t * l + c * r
            players = [players[0], players[-1], *players[1:-1]]
        if worst < 1e-15:
            break
    values = (a ** 2).sum(0)
    order = np.argsort(-values, kind="stable")
    values, a = values[order], a[:, order]
    live = values > 0
    unit = a[:, live] / np.sqrt(values[live])
    if unit.size:
        unit = unit * np.where(unit[np.abs(unit).argmax(0), np.arange(unit.shape[1])] < 0, -1.0, 1.0)
    return values[live], unit


def _triangle(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(total))
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "v"])


def _square(sums: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix of summed cells: size x size values, however many rows there were."""
    out = np.zeros((size, size))
    for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


class Model:
    """Sums of the fit list, eigenvalues, components and trace: everything a row needs."""

    def __init__(self, size: int, n: int, sums: list[int], most: int):
        self.size, self.n, self.sums, self.most = size, n, sums, most
        self.values, self.components, self.trace = np.zeros(0), np.zeros((size, 0)), 0.0

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; Python integers where 64 bits may not do."""
        wide = self.n * self.most + max(map(abs, self.sums), default=0) >= 1 << 62
        kind = object if wide else np.int64
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.shifted(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        d = self.shifted(x)
        if d.dtype != object and self.size * int(np.abs(d).max(initial=0)) ** 2 >= 1 << 62:
            d = d.astype(object)
        return (d * d).sum(axis=1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def _sizes(rows: DataFrame, vector: str) -> int:
    found = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("k")).count().orderBy(
        F.desc("count"), "k").limit(1).collect()
    return found[0]["k"] if found else 0


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    only, size = rows.select(vector), _sizes(rows, vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, most = 0, np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for batch in batches:
            _, x = quantised(batch.column(0), size)
            n, most = n + len(x), max(most, int(np.abs(x).max(initial=0)))
            high, low = high + (x >> 32).sum(0), low + (x & _LOW).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(high, pa.int64()),
             pa.array(low, pa.int64()), pa.array([most] * size, pa.int64())], ["i", "n", "high", "low", "most"])

    got = only.mapInArrow(sums, "i int, n long, high long, low long, most long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("most").alias("most"),
    ).orderBy("i").collect() if size else []  # one row per dimension
    n = got[0]["n"] if got else 0
    model = Model(size, n, [(r["high"] << 32) + r["low"] for r in got], max((r["most"] for r in got), default=0))
    if not n:
        return model

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            _, x = quantised(batch.column(0), size)
            for at in range(0, len(x), BLOCK):
                z = model.centred(x[at:at + BLOCK])
                total += z.T @ z
        yield _triangle(total)

    v = _square(only.mapInArrow(products, "i int, j int, v double"), size) / n
    values, unit = one_sided_jacobi(pivoted_cholesky(v))
    model.values, model.components, model.trace = values[:components], unit[:, :components], float(np.trace(v))
    return model


def identity_error(rows: DataFrame, model: Model, vector: str = "embedding") -> float | None:
    """Largest entry of (covariance of the whitened rows - identity), measured over all rows."""
    k = len(model.values)
    if not k:
        return None
    size = model.size

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            _, x = quantised(batch.column(0), size)
            for at in range(0, len(x), BLOCK):
                w = np.c_[model.whitened(x[at:at + BLOCK]), np.ones(len(x[at:at + BLOCK]))]
                total += w.T @ w
        yield _triangle(total)

    s = _square(rows.select(vector).mapInArrow(products, "i int, j int, v double"), k + 1)
    mean = s[k, :k] / model.n
    return float(np.abs(s[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation (null where 64 bits do not hold it), whitened, explained,
    identity_error, deviation_digits (the same number as text): a row per usable vector and component."""
    model = fit(rows, vector, components)
    error, size, k = identity_error(rows, model, vector), model.size, len(model.values)
    kind = rows.schema[key].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = quantised(batch.column(1), size)
            if not k or not len(at):
                continue
            w, dev = model.whitened(x), model.deviation(x)
            m = len(at)
            fits = [d if d < 1 << 63 else None for d in dev]
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, model.n), pa.int64()), pa.array(fits, pa.int64()).take(each),
                pa.array(w.ravel(), pa.float64()), pa.array(np.tile(model.values / model.trace, m), pa.float64()),
                pa.array(np.full(m * k, error), pa.float64()), pa.array([str(d) for d in dev], pa.string()).take(each),
            ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(
        project, f"key {kind}, component int, n long, deviation long, whitened double, explained double, "
                 "identity_error double, deviation_digits string").withColumnRenamed("key", key)
