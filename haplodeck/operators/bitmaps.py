"""Set questions on integral ids by bitmaps: ids become bits of 32,768-id buckets where they are read, so a
task sends one small bitmap a bucket instead of its ids, and sets are combined bucket by bucket. Exact for
sparse ids too; there a bitmap holds few ids and saves nothing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck.operators.rows import set_difference

MOST_SETS = 6


def id_bitmaps(ids: DataFrame, key: str) -> DataFrame:
    """bucket, bits: the set of a table's ids. Null ids are none; ids that come again change nothing."""
    known = ids.select(F.col(key).cast("long").alias("_id")).where("_id is not null")
    return known.groupBy(F.bitmap_bucket_number("_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))


def merged(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps stored at different times as one set."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [s for k in range(1, len(names) + 1) for s in combinations(names, k)]


def venn_regions(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """has_<name> flags and n of every region that is not empty. The sizes of all unions are taken in one
    aggregate; regions follow by inclusion and exclusion."""
    names = list(sets)
    if not 1 <= len(names) <= MOST_SETS:
        raise ValueError(f"between 1 and {MOST_SETS} sets, not {len(names)}")
    rows = None
    for name, ids in sets.items():
        part = id_bitmaps(ids, key).withColumn("_set", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    subsets = _subsets(names)
    per = rows.groupBy("bucket").agg(*[
        F.bitmap_count(F.bitmap_or_agg(F.when(F.col("_set").isin(list(s)), F.col("bits")))).alias(f"_u{i}")
        for i, s in enumerate(subsets)])
    sums = per.agg(*[F.coalesce(F.sum(f"_u{i}"), F.lit(0)).alias(f"_u{i}") for i in range(len(subsets))])
    union = {frozenset(s): F.col(f"_u{i}") for i, s in enumerate(subsets)} | {frozenset(): F.lit(0)}
    every = frozenset(names)

    def exactly(region: tuple[str, ...]):
        """Ids in all sets of the region and in no other."""
        total = F.lit(0)
        for k in range(len(region) + 1):
            for inner in combinations(region, k):  # ids in no set outside `inner`: all less those outside
                only = union[every] - union[every - frozenset(inner)]
                total = total + only * (-1) ** (len(region) - k)
        return total

    regions = F.array(*[F.struct(*[F.lit(n in s).alias(f"has_{n}") for n in names], exactly(s).cast("long").alias("n"))
                        for s in subsets])
    return sums.select(F.explode(regions).alias("_r")).select("_r.*").where("n > 0")


def difference(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """`rows.set_difference` for large sets that are nearly equal: only ids of buckets in which the bitmaps
    differ are compared one by one."""
    tagged = id_bitmaps(a, key).withColumn("_a", F.lit(True)).unionByName(id_bitmaps(b, key).withColumn("_a", F.lit(False)))
    per = tagged.groupBy("bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("_both"),
        F.bitmap_count(F.bitmap_or_agg(F.when(F.col("_a"), F.col("bits")))).alias("_na"),
        F.bitmap_count(F.bitmap_or_agg(F.when(~F.col("_a"), F.col("bits")))).alias("_nb"))
    unequal = per.where("_both > _na or _both > _nb").select("bucket")

    def among(ids: DataFrame) -> DataFrame:
        at = F.bitmap_bucket_number(F.col(key).cast("long"))
        return ids.select(key).where(F.col(key).isNotNull()).withColumn("bucket", at).join(
            unequal, "bucket", "left_semi").drop("bucket")

    return set_difference(among(a), among(b), key, a_name, b_name)
