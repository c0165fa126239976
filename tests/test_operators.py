import random

import pytest
from pyspark.sql import functions as F

from haplodeck.operators import association as assoc
from haplodeck.operators import callset as cs
from haplodeck.operators import catalogue as cat
from haplodeck.operators import concordance as cc
from haplodeck.operators import intervals as iv
from haplodeck.operators import models as md
from haplodeck.operators import prefix, rnaqc, rows
from haplodeck.operators import telemetry as te
from haplodeck.sources.callers import parse_haplotypes


@pytest.fixture()
def skewed(spark):
    """A third of the rows share one value."""
    rng = random.Random(1)
    vals = [7.0 if i % 3 == 0 else float(rng.randrange(50)) for i in range(900)]
    return vals, spark.createDataFrame(list(enumerate(vals)), "id long, x double")


def test_global_rank_is_exact_and_skew_proof(spark, skewed):
    vals, df = skewed
    got = {r.id: r["rank"] for r in prefix.global_rank(df, [F.col("x").desc(), F.col("id")]).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(enumerate(vals), key=lambda t: (-t[1], t[0])))}
    assert got == want


def test_rank_does_not_depend_on_partitions(spark, skewed):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append({r.id: r["rank"] for r in prefix.global_rank(df, [F.col("x"), F.col("id")]).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_grouped_running_totals(spark, skewed):
    vals, df = skewed
    keyed = df.withColumn("g", F.when(F.col("id") % 4 == 0, "b").otherwise("a")).withColumn("one", F.lit(1))
    got = {r.id: r.one_cum for r in prefix.grouped_running_totals(
        keyed, ["g"], [F.col("x"), F.col("id")], ["one"]).collect()}
    for g in (True, False):
        ids = sorted((i for i in range(len(vals)) if (i % 4 == 0) == g), key=lambda i: (vals[i], i))
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_exact_quantiles(spark, skewed):
    import numpy as np
    vals, df = skewed
    r = prefix.exact_quantiles(df.withColumn("g", F.lit("z")), ["g"], "x",
                               {"q1": 0.25, "q9": 0.9}, {"up": 0.5}).first()
    assert r.q1 == pytest.approx(np.quantile(vals, 0.25)) and r.q9 == pytest.approx(np.quantile(vals, 0.9))
    assert r.up == sorted(vals)[len(vals) // 2]


def test_segmented_steps_match_one_window(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.randrange(5000), i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, t long, id long").withColumn("seg", F.floor(F.col("t") / 300))
    lag = {r.id: r.p for r in prefix.segmented_lag(df, ["k"], ["t", "id"], "seg", {"id": "p"}).collect()}
    run = {r.id: r.s for r in prefix.segmented_running(df, ["k"], ["t", "id"], "seg", {"t": "s"}).collect()}
    top = {r.id: r.m for r in prefix.segmented_running(
        df, ["k"], ["t", "id"], "seg", {"id": "m"}, "max", inclusive=False).collect()}
    for k in "ab":
        mine = sorted((t, i) for kk, t, i in data if kk == k)
        total, seen, prev = 0, [], None
        for t, i in mine:
            total += t
            assert lag[i] == prev and run[i] == total and top[i] == (max(seen) if seen else None)
            seen.append(i)
            prev = i


def test_segmented_steps_keep_rows_without_key(spark):
    df = spark.createDataFrame([(None, 1, 1, 0), (None, 5, 2, 0), (None, 9, 3, 1), ("a", 2, 4, None)],
                               "k string, t long, id long, seg long")
    run = {r.id: r.s for r in prefix.segmented_running(df, ["k"], ["t", "id"], "seg", {"t": "s"}).collect()}
    lag = {r.id: r.p for r in prefix.segmented_lag(df, ["k"], ["t", "id"], "seg", {"id": "p"}).collect()}
    assert run == {1: 1, 2: 6, 3: 15, 4: 2} and lag == {1: None, 2: 1, 3: 2, 4: None}


def test_ordered_queries_read_their_source_twice_at_most(spark, data):
    from haplodeck.plans.queries import QUERIES

    def plan(name):
        return QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()

    for name in ("cost_projection", "telemetry_metrics", "run_sessions", "session_history", "merged_blocks",
                 "clustered_spans"):
        assert plan(name).count("Relation") <= 2, name
    for name in ("risk_deciles", "threshold_metrics"):
        assert "Join Cross" not in plan(name) and "Join Inner\n" not in plan(name)


def test_merge_and_overlap_against_brute_force(spark):
    rng = random.Random(3)
    blocks = [("c1" if i % 3 else "c2", s, s + rng.randrange(1, 4000)) for i in range(300)
              for s in [rng.randrange(400000)]]
    wins = [("c1", s, s + 5000) for s in range(0, 400000, 37000)]
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(blocks)], "id int, c string, s long, e long")
    w = spark.createDataFrame([(i, *x) for i, x in enumerate(wins)], "wid int, wc string, ws long, we long")
    got = {(r.id, r.wid) for r in iv.overlap_join(b, w, ("c", "s", "e"), ("wc", "ws", "we"), 2048).collect()}
    want = {(i, j) for i, (c, s, e) in enumerate(blocks) for j, (wc, ws, we) in enumerate(wins)
            if c == wc and e > ws and s < we}
    assert got == want
    merged = iv.merge_intervals(b.select(F.col("c").alias("contig"), F.col("s").alias("start"),
                                         F.col("e").alias("end")), segment=1000).collect()
    for c in ("c1", "c2"):
        out = []
        for s, e in sorted((s, e) for cc_, s, e in blocks if cc_ == c):
            if out and s <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        assert sorted([r["start"], r["end"]] for r in merged if r.contig == c) == out


def test_windows(spark):
    base = iv.cluster_table(spark)
    merged = {(r["start"], r["end"]) for r in iv.merge_intervals(iv.padded_windows(base, 200000)).collect()}
    assert merged == {(29741260, 30149606), (31068746, 31567067), (32377902, 33291655)}
    cut = {(r["start"], r["end"]) for r in iv.truncated_windows(base, 2000).collect()}
    assert (29944433, 29946433) in cut


def test_fisher_published_values():
    gold = [((2176, 208603, 1078, 323801), "1.486e-221"), ((43, 23951, 95, 76709), "4.559e-02"),
            ((178, 52519, 107, 55124), "4.352e-06"), ((9, 853, 1, 1288), "1.668e-03"),
            ((168, 123808, 414, 411267), "1.373e-03"), ((0, 155, 2, 1994), "1.000e+00")]
    for table, want in gold:
        assert f"{assoc.fisher_two_sided(*table):.3e}" == want


def test_contingency_published_odds(spark):
    cells = [("eur", True, 1, 1927), ("eur", True, 0, 125559), ("eur", False, 1, 849), ("eur", False, 0, 174377)]
    people = spark.createDataFrame(cells, "ancestry string, carrier boolean, case int, k long").withColumn(
        "_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    out = {r.ancestry: r for r in assoc.contingency(people).collect()}
    assert round(out["eur"].odds_ratio, 2) == 3.15 and out["ALL"].n == 302712


def test_marker_policy(spark):
    calls = spark.createDataFrame([
        (1, "DQA1", "05:01", "01:01"), (1, "DQB1", "02:01", "03:01"), (2, "DQA1", "NA", "05:01"),
        (2, "DQB1", "02:01", "02:01")], "person_id long, gene string, a1 string, a2 string")
    markers = [("M", "DQA1", "05:01"), ("M", "DQB1", "02:01")]
    assert {(r.person_id, r.carrier) for r in assoc.marker_carriers(calls, markers).collect()} == {(1, True)}
    kept = assoc.marker_carriers(calls, markers, "noncarrier").collect()
    assert {(r.person_id, r.carrier) for r in kept} == {(1, True), (2, False)}
    with pytest.raises(ValueError):
        assoc.marker_carriers(calls, markers, "other")


def test_model_recovers_a_planted_allele(spark):
    rng = random.Random(4)
    genes = ["A", "B"]
    calls, people = [], []
    for p in range(1500):
        risk = rng.random() < 0.3
        case = int(rng.random() < (0.6 if risk else 0.1))
        people.append((p, rng.choice(["x", "y"]), case))
        calls += [(p, "A", "A*09:09" if risk else "A*01:01", "A*02:0%d" % rng.randrange(1, 4)),
                  (p, "B", "B*0%d:01" % rng.randrange(1, 5), "B*08:01")]
    c = spark.createDataFrame(calls, "person_id long, gene string, a1 string, a2 string")
    who = spark.createDataFrame(people, "person_id long, ancestry string, case int")
    names = md.feature_names(c, who, genes)
    matrix = md.feature_matrix(md.feature_tokens(c, who, genes), names)
    scores = md.out_of_fold_scores(md.stratified_folds(matrix, 3), 3).cache()
    assert scores.where("converged").count() == 1500
    assert scores.count() == 1500 and scores.select("person_id").distinct().count() == 1500
    auc = {r.ancestry: r.auroc for r in assoc.ranking_metrics(scores).collect()}
    assert auc["ALL"] > 0.7
    top = md.top_coefficients(md.coefficients(matrix, names, max_iter=30), 1).where("direction = 'risk'").first()
    assert top.feature == "A*09:09" and top.coefficient > 0
    few = matrix.where("label = 0")
    with pytest.raises(md.TooFewCases):
        md.coefficients(few, names)


def test_homozygous_dosage_is_two(spark):
    c = spark.createDataFrame([(1, "A", "01:01", "A*01:01:02")], "person_id long, gene string, a1 string, a2 string")
    who = spark.createDataFrame([(1, "x", 1)], "person_id long, ancestry string, case int")
    names = md.feature_names(c, who, ["A"])
    v = md.feature_matrix(md.feature_tokens(c, who, ["A"]), names).first().features
    assert [r.feature for r in names.orderBy("index").collect()] == ["A*01:01", "ancestry_x"]
    assert list(v.toArray()) == [2.0, 1.0]


def test_latest_upsert_and_compaction(spark):
    log = spark.createDataFrame([(1, "A", 1, "old"), (1, "A", 2, "new"), (1, "B", 1, "b"), (2, "A", 1, "z")],
                                "p long, gene string, v int, call string")
    got = {(r.p, r.gene): r.call for r in rows.latest_per_key(log, ["p", "gene"], "v").collect()}
    assert got == {(1, "A"): "new", (1, "B"): "b", (2, "A"): "z"}
    new = spark.createDataFrame([(2, "C", 9, "y")], "p long, gene string, v int, call string")
    assert {r.call for r in rows.upsert(log, new, ["p"]).collect()} == {"old", "new", "b", "y"}
    assert rows.compact_fragments(log, new, ["p", "gene"], "v").count() == 4  # every gene survives


def test_seeded_sample_is_stable(spark):
    a = spark.range(1000).withColumnRenamed("id", "k")
    one = {r.k for r in rows.seeded_sample(a, "k", 50, 7).collect()}
    two = {r.k for r in rows.seeded_sample(a.repartition(13), "k", 50, 7).collect()}
    assert one == two and len(one) == 50
    assert one != {r.k for r in rows.seeded_sample(a, "k", 50, 8).collect()}
    assert rows.seeded_sample(a, "k", 5000, 7).count() == 1000


def test_tiers(spark):
    cases = [("01:01", "02:01", "02:01", "01:01", "EXACT"), ("01:02", "02:01", "01:01", "02:01", "CLOSE"),
             ("03:01", "02:01", "01:01", "02:01", "PARTIAL_MISS"), ("03:01", "04:01", "01:01", "02:01", "FULL_MISS")]
    df = spark.createDataFrame(cases, "a string, b string, c string, d string, want string")
    got = df.select("want", cc.agreement_tier(*(F.col(x) for x in "abcd")).alias("t")).collect()
    assert all(r.want == r.t for r in got)


def test_haplotypes_drop_single_rows(spark):
    df = spark.createDataFrame([
        ("p", "HLA-A", "2", "A*02:01;A*02:05", "A*02:01|9|0.9", "5", None, "NA"),
        ("p", "HLA-A", "1", "A*01:01", "A*01:01|9|0.99", "7", "x", "A*01:01"),
        ("p", "HLA-B", "1", "B*07:02", "NA", "7", "x", "B*07:02")],
        "person_id string, Locus string, Chromosome string, Genotype string, Match_info string, "
        "Reads_num string, Step1_type string, One_guess string")
    got = {(r.gene, r.hap): (r.call, r.identity, r.ambig_n, r.step1) for r in parse_haplotypes(df).collect()}
    assert got == {("A", 1): ("A*01:01", 0.99, 1, "x"), ("A", 2): ("A*02:01", 0.9, 2, "NA")}


def test_release_columns_guard(spark):
    with pytest.raises(ValueError):
        cat.release_columns(spark.createDataFrame([("x", "y")], "allele_id string, `3650` string"))


def test_migration_and_histogram_edges(spark):
    old = spark.createDataFrame([(4, 10.0, 50.0)], "concurrency int, wall_seconds double, mem_used_peak_pct double")
    r = rnaqc.migrate_results(old).first()
    assert (r.threads_per_person, r.total_cores, r.mem_used_mean_pct) == (1, 4, 50.0)
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h = rnaqc.histogram(flat, ["x"], 4).first()
    assert (h["bin"], h.n) == (2, 2)


def test_wide_long_round_trip(spark):
    wide = spark.createDataFrame([("1", "01:01", "02:01", "x", None)],
                                 "research_id string, A_1 string, A_2 string, B_1 string, B_2 string")
    long = cs.genotypes_long(wide, ["A", "B"])
    assert {tuple(r) for r in long.collect()} == {("1", "A", "01:01", "02:01"), ("1", "B", "x", None)}
    with pytest.raises(ValueError, match="C_1, C_2"):
        cs.genotypes_long(wide, ["A", "B", "C"])
    assert cs.genotypes_long(wide, ["A", "B", "C"], allow_missing=True).count() == 2
    with pytest.raises(ValueError):
        cs.genotypes_long(wide.select("research_id"), allow_missing=True)


def test_attempts(spark):
    log = spark.createDataFrame([(1, False)] * 3 + [(2, False), (2, True)] + [(3, False)] * 2, "person_id int, ok boolean")
    got = {r.person_id: (r.n_failed, r.done, r.given_up) for r in te.attempt_state(log, 3).collect()}
    assert got == {1: (3, False, True), 2: (1, True, False), 3: (2, False, False)}
