"""The k smallest rows of each set without ordering the table.

The value of the k-th row is found by histograms: counts in equal steps between a set's least and greatest
value, and then the distinct values of the one bin the k-th row falls in. Each histogram is a partial aggregate,
so no row is shuffled whole. Rows at the k-th value are chosen by the next column in the same way, and
only rows that tie in all numeric columns are ordered.

Sets are named by the caller. Between the passes one row per set comes to the driver and goes into the next
pass as a literal; a chain of joins would hold each pass's plan several times over. As the rows are read
several times, give a narrow stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 65_536


def _of_set(by: str, values: dict[str, object]) -> Column:
    """The value of the row's set, null for sets without one."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col(by) == name, F.lit(value)).otherwise(out)
    return out


def _binned(value: Column, lo: Column, hi: Column) -> Column:
    """Bin of a value between lo and hi. Rising with the value; where infinite ends leave no ratio,
    the value is one in between."""
    ratio = (value - lo) / (hi - lo)
    return (
        F.when(value <= lo, 0).when(value >= hi, BINS - 1).when(F.isnan(ratio), BINS // 2)
        .otherwise(F.least(F.floor(ratio * BINS), F.lit(BINS - 1))).cast("long")
    )


def _hits(hist: DataFrame, by: str, order: str, k: dict[str, int]) -> dict[str, dict]:
    """The row of each set's histogram in which its k-th row falls; `left` is its place within."""
    running = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = _of_set(by, k)
    found = hist.withColumn("_upto", F.sum("_n").over(running)).where(
        (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)).collect()  # a row per set
    return {r[by]: {**r.asDict(), "left": k[r[by]] - r["_upto"] + r["_n"]} for r in found}


def kth_value(rows: DataFrame, by: str, value: str, k: dict[str, int]) -> dict[str, tuple[float, int]]:
    """Per set of k the value of its k-th smallest row, and how many rows with just that value belong to
    the first k. Sets with fewer rows than k are missing. `value` is a double without nulls or NaN."""
    v = F.col(value)
    ends = {r[by]: r for r in rows.where(F.col(by).isin(list(k))).groupBy(by).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}  # a row per set
    if not ends:
        return {}
    lo, hi = (_of_set(by, {s: r[end] for s, r in ends.items()}).cast("double") for end in ("lo", "hi"))
    bins = rows.where(lo.isNotNull()).groupBy(by, _binned(v, lo, hi).alias("_bin")).agg(
        F.count("*").alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    near = _hits(bins, by, "_bin", {s: k[s] for s in ends})
    if not near:
        return {}
    lo, hi = (_of_set(by, {s: r[end] for s, r in near.items()}).cast("double") for end in ("_lo", "_hi"))
    values = rows.where(v.between(lo, hi)).groupBy(by, v.alias("_at")).agg(F.count("*").alias("_n"))
    return {s: (r["_at"], r["left"]) for s, r in _hits(values, by, "_at", {s: r["left"] for s, r in near.items()}).items()}


def first_k(rows: DataFrame, by: str, wanted: dict[str, int], order: list[str], last: list[str] = ()) -> DataFrame:
    """The first k rows of every set of `wanted`: ascending by the numeric columns of `order`, then by `last`.

    A set with k below one keeps nothing, one with fewer rows than k all. Rows of other sets and rows whose
    numeric columns are null or NaN are left out. Rows alike in all columns stand for each other."""
    k = {s: n for s, n in wanted.items() if n >= 1}
    tied = rows.where(F.col(by).isin(list(k)))
    for c in order:
        tied = tied.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    kept = []
    for c in order:
        v = F.col(c).cast("double")
        marks = kth_value(tied.withColumn("_v", v), by, "_v", k)
        at = _of_set(by, {s: m[0] for s, m in marks.items()}).cast("double")
        kept.append(tied.where(at.isNull() | (v < at)))  # without a mark all rows of the set are wanted
        tied, k = tied.where(v == at), {s: m[1] for s, m in marks.items()}
    place = F.row_number().over(Window.partitionBy(by).orderBy(*(last or order)))
    kept.append(tied.withColumn("_rn", place).where(F.col("_rn") <= _of_set(by, k).cast("long")).drop("_rn"))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def leading(text: str) -> Column:
    """The first six bytes of a text as a number that rises with the text: a numeric column to select by
    before the text itself decides."""
    return F.conv(F.rpad(F.substring(F.hex(F.col(text).cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")


def key_order(rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """Rows with a numeric column that rises with `key`, and its name: the key itself where it is a number."""
    kind = rows.schema[key].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return rows, key
    return rows.withColumn(f"_lead_{key}", leading(key)), f"_lead_{key}"
