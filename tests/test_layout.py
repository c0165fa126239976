"""Stored layouts: no shuffle on the stored keys, and changes that touch their buckets only."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from haplodeck.operators import confidence as cf
from haplodeck.plans import stored
from haplodeck.sources.layout import BucketTable, open_bucketed, store_bucketed


def exchanges(df):
    return re.findall(r"Exchange (\w+\([^)]*\))", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_on_stored_keys_shuffle_nothing(spark, data, no_broadcast):
    assert exchanges(stored.bucketed_evidence(spark, data)) == []
    assert exchanges(stored.bucketed_calls(spark, data)) == []
    result = exchanges(cf.before_after(stored.bucketed_evidence(spark, data), 0.99, 2.0))
    assert result and all("person_id" not in e for e in result)


def test_a_stored_table_is_one_file_a_bucket_and_opens_again(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "t")
    df = spark.range(500).select((F.col("id") % 50).alias("person_id"), "id")
    store_bucketed(df, path, ["person_id"], 4)
    assert len(list(Path(path).glob("part-*"))) == 4
    again = spark.table(open_bucketed(spark, path, "person_id long, id long", ["person_id"], 4))
    assert again.count() == 500 and exchanges(again.groupBy("person_id").count()) == []


SCHEMA = "person_id string, gene string, v int"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("person_id", "gene", "v").collect())


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet") if "/data/" in str(p)}


def test_upsert_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["person_id"], 32)
    base = [(f"p{i}", g, 1) for i in range(400) for g in "AB"]
    table.create(spark.createDataFrame(base, SCHEMA).repartition(3))
    assert rows_of(table.read()) == sorted(base)
    before, old = files(path), {r.bucket: r.commit for r in table.manifest().collect()}
    new = [(f"p{i}", "C", 2) for i in (7, 123)] + [("new", "A", 2)]
    touched = table.upsert(spark.createDataFrame(new, SCHEMA))
    assert 1 <= len(touched) <= 3
    added = files(path) - before
    assert {int(re.search(r"_bucket=(\d+)", f)[1]) for f in added} == set(touched) and before <= files(path)
    now = {r.bucket: r.commit for r in table.manifest().collect()}
    assert all(now[b] == (1 if b in touched else 0) for b in range(32)) and set(old.values()) == {0}
    want = sorted([r for r in base if r[0] not in ("p7", "p123")] + new)
    assert rows_of(table.read()) == want
    table.upsert(spark.createDataFrame(new, SCHEMA))  # again: the same table
    part = rows_of(table.read(only=touched))
    assert rows_of(table.read()) == want and set(new) <= set(part) < set(want)
    assert table.vacuum() == 2 * len(touched) and rows_of(table.read()) == want
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == []


def test_compaction_keeps_the_last_version(spark, tmp_path):
    rng = random.Random(1)
    table = BucketTable(spark, str(tmp_path / "t"), ["person_id"], 8)
    base = {(f"p{i}", g): 1 for i in range(40) for g in "AB"}
    table.create(spark.createDataFrame([(*k, v) for k, v in base.items()], SCHEMA))
    fragments = [(f"p{rng.randrange(50)}", rng.choice("ABC"), rng.randrange(0, 5)) for _ in range(60)]
    table.compact(spark.createDataFrame(fragments, SCHEMA), ["person_id", "gene"], "v")
    for p, g, v in fragments:
        base[p, g] = max(v, base.get((p, g), v))
    assert rows_of(table.read()) == sorted((*k, v) for k, v in base.items())


def test_null_keys_empty_tables_and_a_failed_change(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["person_id"], 4)
    table.create(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(None, "A", 1), ("x", "A", 1)], SCHEMA))
    assert table.read().count() == 2
    bad = spark.createDataFrame([("x", "B", 2)], SCHEMA).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception):
        table.upsert(bad)
    assert sorted(r.gene for r in table.read().collect()) == ["A", "A"]
