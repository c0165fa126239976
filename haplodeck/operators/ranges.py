"""Overlap of two large sets of intervals by hierarchical bins.

An interval belongs to the level whose bins are just as wide as it is long (each level's are eight times as
wide as those below), so it lies in at most two bins of its level however long it is. Two intervals meet on the
level of the longer one: the longer stands in its own bins, the shorter asks the bins it lies in on every
level above its own that occurs on the other side. A pair is kept in the first bin both lie in.

A bin that holds many rows of a side is dealt over salts: its rows take one salt each, the other side's rows
of that bin come once per salt. Only bins with at least 1/1024 of a side's rows count as such, so there are
few, whatever the data, and their table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplodeck.operators.intervals import plain_contig
from haplodeck.operators.prefix import segmented_running

BASE_BITS, STEP_BITS, LEVELS = 10, 3, 12
HOT_SHARE, SALT_SHARE = 1024, 64
_CELL = ["_contig", "_level", "_bin"]


def level_of(start: Column, end: Column) -> Column:
    """Lowest level whose bins are at least as wide as the interval is long."""
    length, out = end - start, F.lit(0)
    for i in range(LEVELS - 1):
        out = out + (length > (1 << (BASE_BITS + STEP_BITS * i))).cast("int")
    return out


def _placed(df: DataFrame, cols: tuple[str, str, str], tag: str) -> DataFrame:
    """The side's rows as one struct, with contig, bounds and level; rows without extent overlap nothing."""
    c, s, e = cols
    row = F.struct(*[F.col(f"`{x}`") for x in df.columns])
    return df.select(row.alias(f"_{tag}"), plain_contig(F.col(f"`{c}`")).alias("_contig"), F.col(f"`{s}`").cast("long").alias("_s"),
                     F.col(f"`{e}`").cast("long").alias("_e")).where("_contig is not null and _e > _s").withColumn(
        "_own", level_of(F.col("_s"), F.col("_e")))


def _levels(df: DataFrame) -> list[int]:
    return sorted(r["_own"] for r in df.select("_own").distinct().collect())  # at most LEVELS


def _in_bins(df: DataFrame, levels: Column, tag: str) -> DataFrame:
    """A row per level of `levels` and bin there (one or two)."""
    width = F.col("_level") * STEP_BITS + BASE_BITS
    at = df.withColumn("_level", F.explode(levels)).withColumns({
        f"_lo{tag}": F.call_function("shiftright", F.col("_s"), width),
        "_hi": F.call_function("shiftright", F.col("_e") - 1, width)})
    return at.select(f"_{tag}", "_contig", "_level", F.col("_s").alias(f"_s{tag}"), F.col("_e").alias(f"_e{tag}"),
                     f"_lo{tag}", F.explode(F.sequence(f"_lo{tag}", "_hi")).alias("_bin"))


def _hot(rows: DataFrame, name: str) -> DataFrame:
    """Salts of the cells that hold 1/1024 of the rows or more: at most 1024 cells."""
    per = rows.groupBy(*_CELL).agg(F.count("*").alias("_n"))
    total = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).scalar()
    return per.where(F.col("_n") * HOT_SHARE >= total).select(
        *_CELL, F.ceil(F.col("_n") * SALT_SHARE / total).cast("int").alias(name))


def _met(own: DataFrame, probes: DataFrame, own_tag: str, probe_tag: str) -> DataFrame:
    hot = _hot(own, "_ko").join(_hot(probes, "_kp"), _CELL, "full")

    def salted(rows: DataFrame, mine: str, other: str, mine_salt: str, other_salt: str, tag: str) -> DataFrame:
        known = rows.join(F.broadcast(hot), _CELL, "left")
        one = F.lit(1)
        return known.withColumns({
            mine_salt: F.pmod(F.xxhash64(f"_s{tag}", f"_e{tag}", f"_{tag}"), F.coalesce(mine, one)).cast("int"),
            other_salt: F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)),
        }).drop("_ko", "_kp")

    a = salted(own, "_ko", "_kp", "_so", "_sp", own_tag)
    b = salted(probes, "_kp", "_ko", "_sp", "_so", probe_tag)
    return a.join(b, [*_CELL, "_so", "_sp"])


def candidates(left: DataFrame, right: DataFrame, left_cols: tuple, right_cols: tuple) -> DataFrame:
    """Pairs that share a bin on the level of the longer one, before their bounds are compared."""
    a, b = _placed(left, left_cols, "l"), _placed(right, right_cols, "r")
    la, lb = (F.array(*[F.lit(x) for x in levels]).cast("array<int>") for levels in (_levels(a), _levels(b)))
    alone = F.array("_own")
    at_left = _met(_in_bins(a, alone, "l"), _in_bins(b, F.filter(la, lambda x: x >= F.col("_own")), "r"), "l", "r")
    at_right = _met(_in_bins(b, alone, "r"), _in_bins(a, F.filter(lb, lambda x: x > F.col("_own")), "l"), "r", "l")
    return at_left.unionByName(at_right)


def overlap_pairs(left: DataFrame, right: DataFrame, left_cols: tuple, right_cols: tuple) -> DataFrame:
    """Structs `left` and `right` of every pair of half-open intervals that overlap; the columns are
    (contig, start, end). Equal rows each make their own pairs, null contigs or bounds none. Columns of the
    two sides may have the same names."""
    return candidates(left, right, left_cols, right_cols).where(
        (F.col("_el") > F.col("_sr")) & (F.col("_sl") < F.col("_er")) & (F.col("_bin") == F.greatest("_lol", "_lor"))
    ).select(F.col("_l").alias("left"), F.col("_r").alias("right"))


def overlap_totals(left: DataFrame, right: DataFrame, left_cols: tuple, right_cols: tuple,
                   segment_bits: int = 16) -> DataFrame:
    """contig, n_pairs, overlap_bp of the pairs `overlap_pairs` finds, without making them: their number grows
    with the product of the sides, the work here with the sum. Starts and ends are counted per position;
    running counts, cut into segments of positions, say how many intervals of each side are open there.
    Contigs are told without prefix; those without a pair are left out."""
    def ends(df: DataFrame, cols: tuple, mine: str, other: str) -> DataFrame:
        rows = _placed(df.select(*[F.col(f"`{c}`") for c in cols]), cols, "x")
        zero = F.lit(0).cast("long")
        events = F.array(*[
            F.struct(F.col(at).alias("pos"), F.lit(begun).cast("long").alias(f"{mine}_begun"),
                     F.lit(change).cast("long").alias(mine), zero.alias(f"{other}_begun"), zero.alias(other))
            for at, begun, change in (("_s", 1, 1), ("_e", 0, -1))])
        return rows.select(F.col("_contig").alias("contig"), F.explode(events).alias("_v")).select("contig", "_v.*")

    changes = ends(left, left_cols, "l", "r").unionByName(ends(right, right_cols, "r", "l")).groupBy(
        "contig", "pos").agg(*[F.sum(c).alias(c) for c in ("l", "l_begun", "r", "r_begun")])
    spots = segmented_running(
        changes.withColumn("_part", F.call_function("shiftright", F.col("pos"), F.lit(segment_bits))),
        ["contig"], ["pos"], "_part", {"l": "l_open", "r": "r_open"})
    big = {c: F.col(c).cast("decimal(13,0)") for c in ("l", "r", "l_open", "r_open")}
    new = F.col("l_begun") * F.col("r_open") + F.col("r_begun") * (F.col("l_open") - F.col("l_begun"))
    # the open pairs times the way to the next position, summed by parts: what opens or closes here, times here
    step = (big["l_open"] * big["r_open"] - (big["l_open"] - big["l"]) * (big["r_open"] - big["r"])).cast("decimal(27,0)")
    return spots.groupBy("contig").agg(
        F.sum(new).alias("n_pairs"), (-F.sum((step * F.col("pos").cast("decimal(11,0)")).cast("decimal(38,0)"))).cast("long").alias("overlap_bp"),
    ).where("n_pairs > 0")
