import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haplodeck.functions import alleles as al
from haplodeck.functions import callinfo, text, uris
from haplodeck.operators import concordance as cc

NULLS = {"", "NA", "-", "nan", "None", ".", "na"}


def column(spark, values, expr, dtype="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, c {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_null_tokens(spark):
    values = [None, "", " NA ", "-", "nan", "None", ".", "na", "NAN", "A*01:01", "x"]
    assert column(spark, values, text.is_null_token("c")) == [True] * 8 + [False] * 3
    assert column(spark, ["NAN", "none", "A*01"], text.is_null_token("c", True)) == [True, True, False]


def test_two_field_and_truncation(spark):
    values = ["A*01:01:01:01", "01:02", "A*01", "NA", None, "A*:01", " B*07:02 ", "NaN"]
    assert column(spark, values, al.two_field("c")) == [
        "01:01", "01:02", None, None, None, ":01", "07:02", None]
    assert column(spark, values, al.truncate_fields("c", 3)) == [
        "01:01:01"] + [None] * 7


def test_clean_fields(spark):
    values = ["A*24:02:01:01", "DRB1*15:new", "DRB1*15:03:01:NEW", "A*new", "A*01::02:", "A*", "-",
              None, "A*01: new :03", "A*renew:01"]
    assert column(spark, values, al.clean_fields("c")) == [
        "24:02:01:01", "15", "15:03:01", None, "01:02", None, None, None, "01", "renew:01"]
    assert column(spark, ["A*01:new"], al.clean_fields("c", cut_new=False)) == ["01:new"]
    assert column(spark, ["A*01:02:03"], al.depth("c")) == [3]


def test_raw_depth_release_and_gene(spark):
    assert column(spark, ["A*01:02", " ", None, "x"], al.raw_depth("c")) == [2, None, None, 1]
    assert column(spark, ["3650", "116", "3380", "12"], al.decode_release("c")) == [
        "3.65.0", "1.16.0", "3.38.0", "12"]
    assert column(spark, ["HLA-A", "B"], al.bare_gene("c")) == ["A", "B"]
    assert column(spark, ["A*01", "01"], al.gene_of("c")) == ["A", None]


def test_truthy_and_numbers(spark):
    assert column(spark, ["True", "1", " yes ", "no", None], text.truthy("c")) == [
        True, True, True, False, False]
    assert column(spark, ["0.5", "x", "nan", None, " 2 "], text.to_double("c")) == [
        0.5, None, None, None, 2.0]
    assert column(spark, ["real 13m54.2s\nuser 1m0s", "none"], text.minutes_from_real_text("c")) == [
        pytest.approx(13 + 54.2 / 60), None]


def test_match_info(spark):
    info = "A*01|99|0.995;A*02|99|0.99;bad|x|y;short|1"
    df = spark.createDataFrame([(info, "A*02"), ("A*01|9|0.9", "A*05"), ("NA", "A*01"), (None, "A")],
                               "m string, a string")
    e = callinfo.match_entries("m")
    rows = df.withColumn("e", e).select(callinfo.match_identity("e", "a").alias("i"),
                                        callinfo.match_tied("e").alias("t")).collect()
    assert [(r.i, r.t) for r in rows] == [(0.99, True), (None, False), (None, False), (None, False)]
    assert column(spark, ["a;b;;c", "", None], callinfo.ambiguity_count("c")) == [3, 0, 0]


def test_uris(spark):
    values = ["gs://b/x.bam", "gs://old-b/x", "gs://other/x", "rel/x.bam", "", None]
    assert column(spark, values, uris.relative_path("c", "gs://b/", "old-b")) == [
        "x.bam", None, None, "rel/x.bam", None, None]
    assert column(spark, ["a/x.BAM", "a/x.bam.bai", "x.bam", "gs://t"], uris.file_kind("c")) == [
        "primary", "index", None, None]
    assert column(spark, ["chr6:10-20"], uris.region_parts("c"))[0] == ("chr6", 10, 20)


# An independent statement of the cascade, level by level.

def parse(raw):
    if raw is None or raw.strip() in NULLS:
        return None
    parts = [p for p in raw.strip().split("*", 1)[-1].split(":") if p]
    cut = next((i for i, p in enumerate(parts) if p.strip().lower() == "new"), len(parts))
    return parts[:cut] or None


def levels(a, b):
    out = []
    for k in range(1, 5):
        d = min(len(a), len(b))
        if a[:min(k, d)] != b[:min(k, d)]:
            out.append(False)
        else:
            out.append(True if k <= d else None)
    return out


def expected(c, t):
    x, y = [parse(v) for v in c], [parse(v) for v in t]
    if None in x or None in y:
        return None
    options = [(levels(x[0], y[0]), levels(x[1], y[1])), (levels(x[0], y[1]), levels(x[1], y[0]))]
    key = [tuple((a is True) + (b is True) for a, b in zip(*o)) for o in options]
    return options[1] if key[1] > key[0] else options[0]


ALLELE = st.one_of(
    st.sampled_from([None, "", "NA", "-", "A*new", "A*01:new"]),
    st.lists(st.sampled_from(["01", "02", "03"]), min_size=1, max_size=4).map(
        lambda f: "A*" + ":".join(f)))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(ALLELE, ALLELE, ALLELE, ALLELE), min_size=40, max_size=60))
def test_cascade_matches_plain_statement(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, call_1 string, call_2 string, truth_1 string, truth_2 string")
    out = cc.with_cascade(df)
    cols = [F.when(cc.level_true("casc", a, k), True).when(cc.level_false("casc", a, k), False)
            .alias(f"v{a}{k}") for a, k in itertools.product((1, 2), range(1, 5))]
    got = out.select("i", F.col("casc_t1").isNull().alias("none"), *cols).orderBy("i").collect()
    for r, row in zip(got, rows):
        want = expected(row[:2], row[2:])
        assert r.none == (want is None)
        if want:
            assert [list(r[2:6]), list(r[6:10])] == [want[0], want[1]]


def test_swapping_truth_changes_nothing(spark, data):
    from haplodeck.plans import fixtures as fx
    rows = fx.comparison_log(spark, data).where("run_label = 'main'")
    methods = {"base": ("base_1", "base_2"), "sr": ("sr_1", "sr_2")}
    a = cc.cascade_by_method(rows, methods, ("lr_1", "lr_2"), keys=["gene"])
    b = cc.cascade_by_method(rows, methods, ("lr_2", "lr_1"), keys=["gene"])
    left, right = ({(r.gene, r.method, r.field_level): (r.n_true, r.n_false, r.n_na)
                    for r in df.collect()} for df in (a, b))
    assert left == right
    for level in (2, 3, 4):  # a false level stays false further down
        for (g, m, k), (t, f, _) in left.items():
            if k == level:
                assert f >= left[(g, m, level - 1)][1] and t <= left[(g, m, level - 1)][0]
