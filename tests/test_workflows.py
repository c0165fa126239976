from pyspark.sql import functions as F

from haplodeck.plans import fixtures as fx
from haplodeck.plans import workflows as wf

GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def test_concordance_and_callset(spark, data):
    people = fx.persons(spark, data).select("person_id", "ancestry")
    out = wf.concordance_report(fx.comparison_log(spark, data), people, "main", tiebreak=["v"])
    assert out["cascade_counts"].count() == 8 * 5 * 2 * 4
    tiers = out["tiers"].where("gene = 'ALL' and method = 'sr'").first()
    assert tiers.callable_n == tiers.n_exact + tiers.n_close + tiers.n_partial_miss + tiers.n_full_miss
    assert out["missing_people"].count() < people.count()
    calls = fx.callset(spark, data)
    rep = wf.callset_report(calls, fx.catalogue(spark, data), fx.catalogue_history(spark, data))
    total = rep["frequency"].groupBy("gene", "ancestry").agg(F.sum("freq").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in total)
    assert rep["release_lower_bound"].first().release_name.count(".") == 2


def test_selection(spark, data):
    out = wf.cohort_selection(
        fx.manifest(spark, data), fx.inventory(spark, data), fx.cram_manifest(spark, data),
        fx.persons(spark, data), fx.BAM_COLUMNS, fx.BUCKET, fx.REJECTED, 7, GROUPS)
    picked = {r.ancestry: r["count"] for r in out["cohort"].groupBy("ancestry").count().collect()}
    assert picked == {r.ancestry: r.n_picked for r in out["availability"].collect()}


def test_association(spark, data):
    people = fx.persons(spark, data).select("person_id", "ancestry", "case")
    out = wf.association_report(fx.callset(spark, data), people, "narcolepsy", folds=2, max_iter=5)
    scores = out["scores"].cache()
    assert scores.count() == scores.select("person_id").distinct().count() > 0
    none = people.withColumn("case", F.lit(0))
    assert set(wf.association_report(fx.callset(spark, data), none, "celiac")) == {"control_check"}
