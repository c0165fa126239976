"""Hierarchical bins against plain comparison of all pairs."""

import random

from pyspark.sql import functions as F

from haplodeck.operators import ranges as rg

SCHEMA = "contig string, start long, end long, id long"
COLS = ("contig", "start", "end")


def pairs(spark, left, right):
    a, b = spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).repartition(4)
    got = rg.overlap_pairs(a, b, COLS, COLS).select("left.id", F.col("right.id").alias("other"))
    return sorted(tuple(r) for r in got.collect())


def expected(left, right):
    def usable(r):
        return None not in r and r[2] > r[1]

    return sorted((x[3], y[3]) for x in left for y in right if usable(x) and usable(y)
                  and x[0].removeprefix("chr") == y[0].removeprefix("chr") and x[2] > y[1] and x[1] < y[2])


def made(rng, n):
    out = []
    for i in range(n):
        start, length = rng.randrange(0, 3_000_000), int(2 ** rng.uniform(0, 20))
        out.append((rng.choice(["chr6", "6", "chr7"]), start, start + length, i))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(6)
    left, right = made(rng, 250), made(rng, 300)
    edges = [("6", 1024, 2048, 900), ("6", 2048, 2049, 901), ("6", 0, 1024, 902), ("6", 1023, 1025, 903),
             ("6", 8192, 16384, 904), (None, 1, 2, 905), ("6", None, 5, 906), ("6", 9, 9, 907), ("6", 9, 3, 908)]
    assert pairs(spark, left + edges, right + edges) == expected(left + edges, right + edges)
    assert pairs(spark, [], right) == [] and pairs(spark, left, []) == []
    assert pairs(spark, left[:1] * 3, left[:1] * 2) == expected(left[:1] * 3, left[:1] * 2)


def test_a_long_interval_and_a_hot_bin_cost_no_more_than_their_pairs(spark):
    rng = random.Random(7)
    # a third of the reads in one bin, one block as long as the contig
    reads = [("1", 500_000 + rng.randrange(900), 0, i) for i in range(1000)] + [
        ("1", rng.randrange(240_000_000), 0, i) for i in range(1000, 3000)]
    reads = [(c, s, s + 100, i) for c, s, _, i in reads]
    blocks = [("1", 0, 250_000_000, 0)] + [("1", s, s + rng.randrange(200, 3000), i + 1) for i, s in enumerate(
        rng.randrange(240_000_000) for _ in range(2000))]
    want = expected(blocks, reads)
    assert pairs(spark, blocks, reads) == want
    a, b = spark.createDataFrame(blocks, SCHEMA), spark.createDataFrame(reads, SCHEMA)
    assert rg.candidates(a, b, COLS, COLS).count() < 3 * len(want)
    # the long block stands in one bin of its level, not in every small one
    placed = rg._in_bins(rg._placed(a, COLS, "l"), F.array("_own"), "l")
    assert placed.count() <= 2 * len(blocks)
    hot = {r["_ko"] for r in rg._hot(rg._in_bins(rg._placed(b, COLS, "l"), F.array("_own"), "l"), "_ko").collect()}
    assert max(hot) >= 15


def test_totals_equal_the_pairs(spark):
    rng = random.Random(8)
    odd = [("6", 10, 20, 900), ("6", 20, 30, 901), ("6", 20, 30, 902), (None, 1, 2, 903), ("6", 9, 9, 904), ("x", 1, 2, 905)]
    left, right = made(rng, 200) + odd, made(rng, 250) + odd[:-1]
    a, b = spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).repartition(4)
    at = {r[3]: r for r in left}, {r[3]: r for r in right}
    want = {}
    for i, j in expected(left, right):
        x, y = at[0][i], at[1][j]
        n, bases = want.get(x[0].removeprefix("chr"), (0, 0))
        want[x[0].removeprefix("chr")] = (n + 1, bases + min(x[2], y[2]) - max(x[1], y[1]))
    for bits in (4, 16):
        got = rg.overlap_totals(a, b, COLS, COLS, segment_bits=bits).collect()
        assert {r.contig: (r.n_pairs, r.overlap_bp) for r in got} == want


def test_totals_do_not_make_the_pairs(spark):
    """300 million pairs on one contig: their number only."""
    a = spark.range(30_000).select(F.lit("6").alias("contig"), F.col("id").alias("start"), (F.col("id") + 40_000).alias("end"))
    b = spark.range(10_000).select(F.lit("6").alias("contig"), F.lit(30_000).alias("start"), F.lit(30_001).alias("end"))
    assert [tuple(r) for r in rg.overlap_totals(a, b, COLS, COLS).collect()] == [("6", 300_000_000, 300_000_000)]
