"""The L1 logistic problem with a penalised intercept, solved to its optimum on Spark aggregates.

Minimised is  sum |w_j| + |b| + C sum log(1 + exp(-y z)),  z = b + sum w_j x_j / s_j,  with s_j the population
deviation of feature j over the fitted rows (1 where it is 0) and no centring. Each step is one pass over the
sparse rows, written once as blocks of bytes, which returns the loss, the gradient of every feature and the second derivatives of the active ones
as sums of cells; the driver holds one number per feature and one per pair of active features, whatever the
number of rows. A proximal Newton step follows: coordinate descent on the quadratic model, halved until the
objective falls. The fit ends when no feature breaks the optimality conditions by more than `tolerance`:
gradient + sign(w) = 0 where w is not zero, |gradient| <= 1 where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck.operators.models import check_cases, feature_dosages
from haplodeck.session import cut_lineage

TOLERANCE, MOST_PASSES = 1e-7, 200
#: Rows made dense at a time, for the active features only.
BLOCK = 2048


@dataclass
class Fit:
    weights: np.ndarray  # per scaled unit, in index order
    intercept: float
    scale: np.ndarray
    violation: float
    passes: int


def sparse_rows(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """person_id, ancestry, label, idx, dose: the names in a person's tokens by index, and how often."""
    pairs = feature_dosages(tokens, names).groupBy("person_id").agg(
        F.sort_array(F.collect_list(F.struct("index", "dosage"))).alias("_p"))  # a few dozen a person
    none = F.array().cast("array<struct<index:int,dosage:double>>")
    return tokens.drop("tokens").join(pairs, "person_id", "left").withColumn("_p", F.coalesce("_p", none)).withColumns({
        "idx": F.transform("_p", lambda p: p["index"].cast("int")), "dose": F.transform("_p", lambda p: p["dosage"]),
    }).drop("_p")


def deviations(rows: DataFrame, size: int) -> np.ndarray:
    """Population deviation of every feature, 1 where it is 0: one number per feature."""
    n = rows.count()
    per = rows.select(F.explode(F.arrays_zip("idx", "dose")).alias("_p")).groupBy(F.col("_p.idx").alias("i")).agg(
        F.sum("_p.dose").alias("s"), F.sum(F.col("_p.dose") * F.col("_p.dose")).alias("q")).collect()
    out = np.zeros(size)
    for r in per:
        out[r["i"]] = np.sqrt(max(r["q"] / n - (r["s"] / n) ** 2, 0.0))
    return np.where(out > 0, out, 1.0)


def packed(rows: DataFrame) -> DataFrame:
    """fold (-1 without one), y, size, idx, dose: the rows of an Arrow batch and fold as the bytes of four arrays,
    so that the passes over them neither build rows nor copy lists."""
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = np.asarray(batch.column(0))
            for f in np.unique(folds):
                part = batch.filter(pa.array(folds == f))
                parts = [np.asarray(part.column(1)).astype(np.float64), np.asarray(part.column(2).value_lengths()),
                         np.asarray(part.column(2).flatten()), np.asarray(part.column(3).flatten())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], pa.int32()), *[pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in zip(
                        parts, (np.float64, np.int32, np.int32, np.float64))]], ["fold", "y", "size", "idx", "dose"])

    return cut_lineage(rows.select(fold.alias("fold"), F.col("label").cast("double").alias("label"), F.col("idx").cast(
        "array<int>").alias("idx"), F.col("dose").cast("array<double>").alias("dose")).mapInArrow(
            run, "fold int, y binary, size binary, idx binary, dose binary"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(y, size, idx, dose) of at most BLOCK rows."""
    for i in range(batch.num_rows):
        y, size, j, x = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate(
            (np.float64, np.int32, np.int32, np.float64)))
        first = np.concatenate([[0], np.cumsum(size)])
        for at in range(0, len(y), BLOCK):
            to = min(at + BLOCK, len(y))
            yield y[at:to], size[at:to], j[first[at]:first[to]], x[first[at]:first[to]]


def _pass(blocks: DataFrame, w: np.ndarray, b: float, scale: np.ndarray, c: float, active: np.ndarray):
    """(loss, gradient with the intercept last, second derivatives of the active features and the intercept)."""
    p, k = len(w), len(active) + 1
    step, place = w / scale, np.full(p + 1, -1)
    place[active], place[p] = np.arange(k - 1), k - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, second = 0.0, np.zeros(p + 1), np.zeros((k, k))
        for batch in batches:
            for y, size, j, x in _blocks(batch):
                row = np.repeat(np.arange(len(y)), size)
                z = b + np.bincount(row, step[j] * x, len(y))
                loss += np.logaddexp(0, np.where(y > 0, -z, z)).sum()
                m = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                grad[:p] += np.bincount(j, (m - y)[row] * x, p)[:p]
                grad[p] += (m - y).sum()
                live = place[j] >= 0
                dense = np.bincount(row[live] * k + place[j[live]], x[live] / scale[j[live]], len(y) * k).reshape(-1, k)
                dense[:, k - 1] = 1
                second += (dense * (m * (1 - m))[:, None]).T @ dense
        cells = np.concatenate([[loss], grad, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

    got = blocks.select("y", "size", "idx", "dose").mapInArrow(run, "cell long, v double").groupBy("cell").agg(
        F.sum("v").alias("v")).toArrow()
    cells = np.zeros(1 + p + 1 + k * k)
    cells[got["cell"].to_numpy()] = got["v"].to_numpy()
    grad = cells[1:p + 2] * c
    grad[:p] /= scale
    return cells[0] * c, grad, cells[p + 2:].reshape(k, k) * c


def violations(theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
    return np.where(theta != 0, np.abs(grad + np.sign(theta)), np.maximum(np.abs(grad) - 1, 0))


def _descent(theta: np.ndarray, grad: np.ndarray, second: np.ndarray, most: int = 1000) -> np.ndarray:
    """Minimiser of the quadratic model plus the L1 norm, by coordinate descent."""
    new, g = theta.copy(), grad.copy()
    diagonal = np.diag(second) + 1e-10 * max(np.diag(second).max(initial=0), 1e-12)
    for _ in range(most):
        moved = 0.0
        for j in range(len(new)):
            u = new[j] - g[j] / diagonal[j]
            to = np.sign(u) * max(abs(u) - 1 / diagonal[j], 0.0)
            if to != new[j]:
                g += second[:, j] * (to - new[j])
                moved = max(moved, abs(to - new[j]) * np.sqrt(diagonal[j]))
                new[j] = to
        if moved < 1e-12:
            break
    return new


def solve(rows: DataFrame, size: int, c: float = 0.1, tolerance: float = TOLERANCE,
          most_passes: int = MOST_PASSES, blocks: DataFrame | None = None) -> Fit:
    """Optimum over stored rows (label, idx, dose) of `size` features; `blocks` are the same rows `packed`."""
    scale, blocks = deviations(rows, size), packed(rows) if blocks is None else blocks
    theta = np.zeros(size + 1)
    every = np.arange(size)
    loss, grad, _ = _pass(blocks, theta[:-1], theta[-1], scale, c, every[:0])
    passes, worst = 1, violations(theta, grad).max()
    while worst > tolerance and passes < most_passes:
        active = every[(theta[:-1] != 0) | (np.abs(grad[:-1]) > 1 - 1e-9)]
        loss, grad, second = _pass(blocks, theta[:-1], theta[-1], scale, c, active)
        passes += 1
        at = np.append(active, size)
        step = _descent(theta[at], grad[at], second) - theta[at]
        cost, share = loss + np.abs(theta).sum(), 1.0
        while passes < most_passes:
            trial = theta.copy()
            trial[at] += share * step
            new_loss, new_grad, _ = _pass(blocks, trial[:-1], trial[-1], scale, c, every[:0])
            passes += 1
            if new_loss + np.abs(trial).sum() <= cost + 1e-12 * abs(cost) or share < 1e-8:
                break
            share /= 2
        theta, loss, grad = trial, new_loss, new_grad
        worst = violations(theta, grad).max()
    return Fit(theta[:-1], float(theta[-1]), scale, float(worst), passes)


def coefficients(rows: DataFrame, names: DataFrame, c: float = 0.1) -> DataFrame:
    """feature, coefficient and odds ratio per scaled copy, of one fit on all rows; the intercept as
    `(intercept)`."""
    check_cases(rows)
    rows = cut_lineage(rows)
    fit = solve(rows, names.count(), c)
    table = rows.sparkSession.createDataFrame(
        [(i, float(v)) for i, v in enumerate(fit.weights)], "index int, coefficient double")
    out = names.join(table, "index").select("feature", "coefficient")
    own = rows.sparkSession.createDataFrame([("(intercept)", fit.intercept)], "feature string, coefficient double")
    return out.unionByName(own).withColumn("odds_ratio", F.exp("coefficient"))


def optimality(tokens: DataFrame, names: DataFrame, table: DataFrame, c: float = 0.1) -> DataFrame:
    """feature, coefficient, gradient, violation: the conditions at `table`'s coefficients, recomputed by joins
    and sums over the tokens, without the solver's passes."""
    doses = cut_lineage(feature_dosages(tokens, names))
    n = tokens.agg(F.count("*").alias("n"))
    per = doses.groupBy("index").agg(F.sum("dosage").alias("s"), F.sum(F.col("dosage") * F.col("dosage")).alias("q"))
    spread = names.join(per, "index", "left").withColumn("n", n.scalar()).select(
        "index", "feature", F.sqrt(F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0.0)) / F.col("n") - (
            F.coalesce("s", F.lit(0.0)) / F.col("n")) ** 2)).alias("_d"))
    known = cut_lineage(spread.withColumn("_d", F.when(F.col("_d") > 0, F.col("_d")).otherwise(1.0)).join(table, "feature"))
    intercept = table.where("feature = '(intercept)'").select("coefficient").scalar()
    z = doses.join(known, "index").groupBy("person_id").agg(
        F.sum(F.col("dosage") * F.col("coefficient") / F.col("_d")).alias("_z"))
    lean = tokens.select("person_id", "label").join(z, "person_id", "left").select(
        "person_id", (1 / (1 + F.exp(-(F.coalesce("_z", F.lit(0.0)) + intercept))) - F.col("label")).alias("_r"))
    lean = cut_lineage(lean)
    sums = doses.join(lean, "person_id").groupBy("index").agg(F.sum(F.col("dosage") * F.col("_r")).alias("_g"))
    grads = known.join(sums, "index", "left").select(
        "feature", "coefficient", (F.coalesce("_g", F.lit(0.0)) * c / F.col("_d")).alias("gradient"))
    own = lean.agg((F.sum("_r") * c).alias("gradient")).select(
        F.lit("(intercept)").alias("feature"), intercept.alias("coefficient"), "gradient")
    w, g = F.col("coefficient"), F.col("gradient")
    return grads.unionByName(own).withColumn("violation", F.when(w != 0, F.abs(g + F.signum(w))).otherwise(
        F.greatest(F.abs(g) - 1, F.lit(0.0))))


def out_of_fold_scores(folded: DataFrame, size: int, n: int = 5, c: float = 0.1) -> DataFrame:
    """person_id, ancestry, label, fold, score: every person scored by the optimum of the other folds."""
    check_cases(folded)
    folded = cut_lineage(folded)
    blocks, out = packed(folded), None
    for fold in range(n):
        others = F.col("fold") != fold
        fit = solve(folded.where(others), size, c, blocks=blocks.where(others))
        step, b = fit.weights / fit.scale, fit.intercept

        def run(batches: Iterator[pa.RecordBatch], step=step, b=b) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.asarray(batch.column(4).value_lengths())
                row = np.repeat(np.arange(batch.num_rows), sizes)
                j, x = np.asarray(batch.column(4).flatten()), np.asarray(batch.column(5).flatten())
                score = 1 / (1 + np.exp(-(b + np.bincount(row, step[j] * x, batch.num_rows))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score)],
                                                 [*batch.schema.names[:4], "score"])

        held = folded.where(F.col("fold") == fold).select(
            "person_id", "ancestry", F.col("label").cast("int").alias("label"), "fold", "idx", "dose")
        kind = ", ".join(f"{c_} {held.schema[c_].dataType.simpleString()}" for c_ in held.columns[:4])
        part = held.mapInArrow(run, f"{kind}, score double")
        out = part if out is None else out.unionByName(part)
    return out
