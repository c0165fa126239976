"""Selection by histograms against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from haplodeck.operators import selection as sel

SCHEMA = "tool string, score double, person_id long, gene string"


def expected(rows, k):
    out = []
    for tool, n in k.items():
        own = sorted((r for r in rows if r[0] == tool and r[1] is not None and r[1] == r[1]), key=lambda r: r[1:])
        out += own[:max(n, 0)]
    return sorted(out)


def chosen(spark, rows, k, parts=6):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sel.first_k(df, "tool", k, ["score", "person_id"], ["gene"])
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_sorting(spark, seed):
    rng = random.Random(seed)
    levels = [lambda: rng.random(), lambda: rng.choice([0.5, 0.75]), lambda: 10.0 ** rng.randrange(-300, 300)][seed]
    rows = [(rng.choice("ab"), levels(), rng.randrange(60), rng.choice("ABCD")) for _ in range(900)]
    rows = list({(t, p, g): (t, s, p, g) for t, s, p, g in rows}.values())
    for k in ({"a": 1, "b": 150}, {"a": 77, "b": 5000}):
        assert chosen(spark, rows, k) == expected(rows, k)


def test_ties_infinities_nulls_and_empty_sets(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1.0, i, g) for i in range(20) for g in "AB"] + [("b", v, i, "A") for i, v in enumerate(
        [inf, -inf, 0.0, -0.0, 2.5, None, nan, inf, -inf])] + [("c", 1.0, 1, "A")]
    assert chosen(spark, rows, {"a": 5}) == [("a", 1.0, i, g) for i in range(3) for g in "AB"][:5]
    for n in (1, 4, 8):
        got = chosen(spark, rows, {"a": 0, "b": n})
        assert len(got) == min(n, 7) and [r[2] for r in sorted(got, key=lambda r: r[1:])] == [1, 8, 2, 3, 4, 0, 7][:n]


def test_no_row_is_shuffled_whole(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("tool"), (F.xxhash64("id") / 2.0 ** 63).alias("score"),
        F.col("id").alias("person_id"), F.lit("A").alias("gene")).write.parquet(path)
    df = spark.read.parquet(path)
    got = sel.first_k(df, "tool", {"a": 1000, "b": 1000}, ["score", "person_id"], ["gene"])
    want = df.withColumn("_r", F.expr("row_number() over (partition by tool order by score, person_id)")).where("_r <= 1000")
    assert sorted(r.person_id for r in got.collect()) == sorted(r.person_id for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():  # exchanges carry bins, values of one bin or tied rows, never the table
        assert "Exchange hashpartitioning(person_id" not in line and "rangepartitioning" not in line


def test_empty_input_and_nothing_wanted(spark):
    assert chosen(spark, [], {"a": 3}) == []
    df = spark.createDataFrame([("a", 1.0, 1, "A")], SCHEMA)
    assert sel.first_k(df, "tool", {}, ["score"]).count() == 0


def test_text_keys_rise_with_their_numbers(spark):
    texts = ["", "a", "ab", "abcdefg", "abcdefz", "b", "é", "語"]
    df = spark.createDataFrame([(t,) for t in texts], "person_id string")
    rows, name = sel.key_order(df, "person_id")
    assert [r.person_id for r in rows.orderBy(name, "person_id").collect()] == sorted(texts, key=str.encode)
