"""Bitmaps against Python sets, sketches against exact ranks and against one pass."""

import random

import pytest

from haplodeck.operators import bitmaps as bm
from haplodeck.operators import sketches as sk


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "person_id long").repartition(3)


def test_regions_and_differences_equal_sets(spark):
    rng = random.Random(2)
    sparse = [rng.randrange(10 ** 12) for _ in range(200)]
    pool = sparse + list(range(32_700, 32_900)) + [0, 32_767, 32_768, 65_535, 65_536]
    ids = {n: [rng.choice(pool) for _ in range(260)] for n in "abc"}
    sets = {n: set(v) for n, v in ids.items()}
    got = {(r.has_a, r.has_b, r.has_c): r.n for r in bm.venn_regions(
        {n: frame(spark, [*v, None, v[0]]) for n, v in ids.items()}, "person_id").collect()}
    want = {}
    for i in set().union(*sets.values()):
        flags = tuple(i in sets[n] for n in "abc")
        want[flags] = want.get(flags, 0) + 1
    assert got == want
    near = sets["a"] - set(sorted(sets["a"])[:3]) | {5, 10 ** 15}
    rows = bm.difference(frame(spark, sets["a"]), frame(spark, [*near, None]), "person_id", "left", "right").collect()
    assert {(r.person_id, r.only_in) for r in rows} == {(i, "left") for i in sets["a"] - near} | {(i, "right") for i in near - sets["a"]}


def test_stored_bitmaps_merge_and_empty_sets(spark):
    a, b = [1, 2, 40_000], [2, 3, 32_768]
    both = bm.merged(bm.id_bitmaps(frame(spark, a), "person_id").unionByName(bm.id_bitmaps(frame(spark, b), "person_id")))
    once = bm.id_bitmaps(frame(spark, a + b), "person_id")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, once.collect()))
    none = frame(spark, [])
    assert bm.venn_regions({"x": none, "y": none}, "person_id").collect() == []
    assert [tuple(r) for r in bm.difference(frame(spark, [7]), none, "person_id", "l", "r").collect()] == [(7, "l")]
    with pytest.raises(ValueError):
        bm.venn_regions({}, "person_id")


def test_merged_sketches_are_near_the_exact_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), rng.choice([0.5, 2.0])]) for _ in range(20_000)]
    rows = [(i % 7, v, None if i % 10 else float(i), f"k{i % 3000}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "day long, x double, y double, key string").repartition(5)
    got = {r.metric: r for r in sk.described(sk.merged_summaries(sk.part_summaries(df, ["x", "y"], "day"))).collect()}
    ordered = sorted(values)
    for p in (25, 50, 75):
        q = got["x"][f"p{p}"]
        low, high = sum(v < q for v in ordered) / len(ordered), sum(v <= q for v in ordered) / len(ordered)
        assert low <= p / 100 + 0.02 and high >= p / 100 - 0.02
    mean = sum(values) / len(values)
    assert got["x"].n == 20_000 and got["x"]["min"] == ordered[0] and got["x"]["max"] == ordered[-1]
    assert got["x"]["mean"] == pytest.approx(mean) and got["y"].n == 2000
    assert got["x"]["std"] == pytest.approx((sum((v - mean) ** 2 for v in values) / 19_999) ** 0.5)
    merged = sk.distinct_estimate(sk.part_distincts(df, "key", "day")).first()[0]
    one_pass = sk.distinct_estimate(sk.part_distincts(df.selectExpr("0L as day", "key"), "key", "day")).first()[0]
    assert merged == one_pass and abs(merged - 3000) <= 150
    assert sk.merged_summaries(sk.part_summaries(df.limit(0), ["x"], "day")).count() == 0
