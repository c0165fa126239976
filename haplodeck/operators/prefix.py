"""Ordered computation without a single-partition or single-key window.

Two families:

* `global_rank`, `running_totals`, `exact_quantiles` order a whole table. The rows are range
  partitioned on the full order (which ends in a unique key, so a value held by a third of all
  rows is still split), sorted inside each partition and written once to the checkpoint folder.
  Only one row per partition meets in the small offset table.
* `segmented_lag`, `segmented_running` order the rows of each key. The key's rows are cut into
  segments by an expression that grows with the order (an hour, a megabase), each segment is a
  window of its own, and one summary row per segment carries the state over the border.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit
_ROW_MASK = (1 << _ROW_BITS) - 1
_FEW_GROUPS = 10_000  # up to here the groups' starting levels are broadcast


def _sequenced(df: DataFrame, order: list[Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    return cut_lineage(ranged).withColumn("_block", F.shiftright("_seq", _ROW_BITS))


def _block_offsets(blocks: DataFrame, values: list[str]) -> DataFrame:
    """Exclusive prefix sums over blocks, and the whole sums: one row per range partition, so at most
    as many rows as there are shuffle partitions. That bound is why it is broadcast."""
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.broadcast(blocks.select(
        "_block",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(v).over(whole).alias(f"_whole_{v}") for v in values],
    ))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank",
                total: str | None = None) -> DataFrame:
    """Exact 1-based position of every row; `order` must end in a key that makes it total. `total`
    names a column for the number of rows. The ordered rows are not shuffled again."""
    seq = _sequenced(df, order)
    offsets = _block_offsets(seq.groupBy("_block").agg(F.count("*").alias("n")), ["n"])
    out = seq.join(offsets, "_block").withColumn(
        name, F.col("_before_n") + F.col("_seq").bitwiseAND(F.lit(_ROW_MASK)) + 1)
    if total:
        out = out.withColumn(total, F.col("_whole_n"))
    return out.drop("_block", "_seq", "_before_n", "_whole_n")


def running_totals(df: DataFrame, order: list[Column], values: list[str],
                   suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of `values` over the whole table in `order`."""
    seq = _sequenced(df, order)
    offsets = _block_offsets(seq.groupBy("_block").agg(*[F.sum(v).alias(v) for v in values]), values)
    inside = Window.partitionBy("_block").orderBy("_seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = seq.withColumns({f"{v}{suffix}": F.sum(v).over(inside) for v in values}).join(
        offsets, "_block"
    )
    return out.withColumns(
        {f"{v}{suffix}": F.col(f"{v}{suffix}") + F.col(f"_before_{v}") for v in values}
    ).drop("_block", "_seq", *[f"_{k}_{v}" for v in values for k in ("before", "whole")])


def grouped_running_totals(df: DataFrame, group: list[str], order: list[Column],
                           values: list[str], suffix: str = "_cum") -> DataFrame:
    """Running sums that restart at every group. Groups may be of any size: the table is ordered
    by (group, order) as a whole and each group's starting level is taken off afterwards."""
    total = running_totals(df, [F.col(g) for g in group] + order, values, suffix)
    base = total.groupBy(*group).agg(
        *[F.min(F.col(f"{v}{suffix}") - F.col(v)).alias(f"_base_{v}") for v in values]
    )
    few = base.limit(_FEW_GROUPS + 1).count() <= _FEW_GROUPS  # over rows already written
    joined = total.alias("t").join(
        F.broadcast(base.alias("b")) if few else base.alias("b"), reduce(
            lambda a, b: a & b, [F.col(f"t.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
        )
    )
    return joined.select(
        *[F.col(f"t.{c}") for c in total.columns if not c.endswith(suffix)],
        *[(F.col(f"t.{v}{suffix}") - F.col(f"b._base_{v}")).alias(f"{v}{suffix}") for v in values],
    )


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float],
                    upper: dict[str, float] | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any size.

    Equal values are counted first, so the ordered table holds distinct values only. `upper`
    names order statistics taken at position floor(n*p) of the 0-based sorted list instead.
    """
    upper = upper or {}
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count("*").alias("n"))
    )
    cum = grouped_running_totals(hist, group, [F.col(value)], ["n"])
    sizes = hist.groupBy(*group).agg(F.sum("n").alias("_total"))
    cum = cum.join(sizes, group)
    last, first = F.col("n_cum"), F.col("n_cum") - F.col("n")  # 0-based span: first <= i < last

    def at(position: Column) -> Column:
        return F.max(F.when((position >= first) & (position < last), F.col(value)))

    exprs = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        exprs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                  F.max(pos - F.floor(pos)).alias(f"_fr_{name}")]
    for name, p in upper.items():
        exprs.append(at(F.floor(F.col("_total") * F.lit(float(p)))).alias(name))
    out = cum.groupBy(*group).agg(F.max("_total").alias("n_values"), *exprs)
    for name in probs:
        lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        out = out.withColumn(name, lo + (hi - lo) * fr)
    return out.drop(*[f"_{k}_{n}" for n in probs for k in ("lo", "hi", "fr")])


def _with_carry(local: DataFrame, carry: DataFrame, on: list[str]) -> DataFrame:
    """Joins one summary row per (keys, segment); null keys and segments are a group of their own."""
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    extra = [c for c in carry.columns if c not in on]
    return local.alias("l").join(carry.alias("r"), same).select(
        *[F.col(f"l.{c}") for c in local.columns], *[F.col(f"r.{c}") for c in extra])


def segmented_lag(df: DataFrame, keys: list[str], order: list[str], segment: str,
                  columns: dict[str, str]) -> DataFrame:
    """Previous row's values per key. `segment` must not decrease along `order`; `columns` maps
    source column -> output column. The summary window sees one row per (key, segment). The input is
    read twice, so it is written once first: chained steps read their source once."""
    df = cut_lineage(df)
    by_segment = Window.partitionBy(*keys, segment).orderBy(*order)
    state = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
                     *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    tails = df.groupBy(*keys, segment).agg(F.max(state).alias("_tail"))
    previous = tails.select(
        *keys, segment,
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy(segment)).alias("_carry"),
    )
    local = df.withColumns({
        "_first": F.row_number().over(by_segment) == 1,
        **{out: F.lag(src).over(by_segment) for src, out in columns.items()},
    })
    return _with_carry(local, previous, [*keys, segment]).withColumns({
        out: F.when(F.col("_first"), F.col(f"_carry.v{i}")).otherwise(F.col(out))
        for i, out in enumerate(columns.values())
    }).drop("_first", "_carry")


def segmented_running(df: DataFrame, keys: list[str], order: list[str], segment: str,
                      columns: dict[str, str], how: str = "sum", inclusive: bool = True) -> DataFrame:
    """Running sums or maxima per key in `order`, exclusive of the row itself on request; `columns`
    maps source column -> output column, all in one pass. Reads its input as `segmented_lag` does."""
    df = cut_lineage(df)
    fn = {"sum": F.sum, "max": F.max}[how]
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, end
    )
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    outs = list(columns.values())
    totals = df.groupBy(*keys, segment).agg(
        *[fn(c).alias(f"_level{i}") for i, c in enumerate(columns)]).select(
        *keys, segment, *[fn(f"_level{i}").over(before).alias(f"_carry{i}") for i in range(len(outs))])
    local = df.withColumns({f"_here{i}": fn(c).over(inside) for i, c in enumerate(columns)})
    joined = _with_carry(local, totals, [*keys, segment])

    def value(i: int) -> Column:
        if how == "sum":
            return F.coalesce(F.col(f"_here{i}"), F.lit(0)) + F.coalesce(F.col(f"_carry{i}"), F.lit(0))
        return F.greatest(F.col(f"_here{i}"), F.col(f"_carry{i}"))  # greatest skips nulls

    return joined.withColumns({out: value(i) for i, out in enumerate(outs)}).drop(
        *[f"_{k}{i}" for i in range(len(outs)) for k in ("here", "carry")])
