"""What keeps the work of the queries in proportion to the tables."""

from pyspark.sql import functions as F

from haplodeck.operators import census as cen, cohort as co, lasso as ls, models as md
from haplodeck.plans import fixtures as fx, queries, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_rows_are_chosen_before_they_get_their_genes(spark, data):
    text = plan(queries._latest(spark, data))
    assert text.index("Generate") < text.index("WindowGroupLimit")  # a plan is printed from its end


def test_people_keep_their_partitions(spark, data, monkeypatch):
    monkeypatch.setattr(fx, "PEOPLE_PER_PART", 100)
    n = fx.table(spark, data, "orders").count()
    parts = fx.persons(spark, data).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 0.8 * n / 100


def test_labels_are_compared_without_a_second_reading(spark, data):
    text = plan(queries.QUERIES["config_comparison"](spark, data))
    assert "gene" not in "".join(line for line in text.splitlines() if "Join [" in line)


def test_only_lines_of_the_log_are_stored(spark, data, monkeypatch):
    seen = []
    plain = stored._stored

    def noted(session, df, keys):
        seen.append(("lr_1" in df.columns, keys))
        return plain(session, df, keys)

    monkeypatch.setattr(stored, "_stored", noted)
    stored.QUERIES["bucketed_latest"](spark, data)
    assert seen == [(False, ["person_id"])]


def joins(df):
    return [line for line in plan(df).splitlines() if "SortMergeJoin" in line]


def test_values_meet_their_quartiles_without_a_shuffle_by_metric(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if nothing were known to be small
    try:
        assert len(joins(queries.QUERIES["qc_describe_sketch"](spark, data))) == 1  # of the two results
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tokens_meet_their_names_without_a_shuffle_by_name(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not [line for line in joins(md.feature_dosages(*queries._tokens(spark, data))) if "[feature" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_passes_of_the_fit_read_blocks(spark):
    rows = spark.createDataFrame([(i % 3, float(i % 2), [0, 2], [1.0, float(i)]) for i in range(60)],
                                 "fold int, label double, idx array<int>, dose array<double>")
    blocks = ls.packed(rows.coalesce(1))
    assert blocks.count() == 3
    got = [(y, list(j), list(x)) for batch in blocks.where("fold <> 1").select("y", "size", "idx", "dose").toArrow().to_batches()
           for ys, size, js, xs in ls._blocks(batch)
           for y, j, x in zip(ys, js.reshape(-1, 2), xs.reshape(-1, 2))]
    assert sorted(got) == sorted((r.label, r.idx, r.dose) for r in rows.where("fold <> 1").collect())


def test_evidence_stays_where_its_people_are(spark, data):
    text = plan(queries._evidence_rows(spark, data))
    assert "person_id" in text and not [x for x in text.splitlines() if "Exchange hashpartitioning(" in x and "gene#" in x.split("),")[0]]


def test_stored_versions_get_their_genes_where_they_are_written(spark, data, monkeypatch):
    seen = []
    plain = stored.BucketTable._commit

    def noted(self, rows, commit, *rest):
        seen.append(plan(rows))
        plain(self, rows, commit, *rest)

    monkeypatch.setattr(stored.BucketTable, "_commit", noted)
    stored.QUERIES["bucket_compaction"](spark, data)
    first = seen[0].splitlines()
    assert "Exchange rangepartitioning(_bucket" in seen[0]
    assert not any("Generate" in x for x in first[next(i for i, x in enumerate(first) if "rangepartitioning" in x):])


def test_paths_meet_the_listing_sorted_by_a_number(spark, data, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries._existing(spark, data)
        (line,) = joins(found)
        assert line.count("xxhash64(") == 2 and "LeftSemi, (" in line
        sorts = [x for x in plan(found).splitlines() if " Sort [" in x]
        assert sorts and all("Sort [xxhash64(" in x and x.count("ASC") == 1 for x in sorts)
        wanted = sorted(map(tuple, found.collect()))
        monkeypatch.setattr(co.F, "xxhash64", F.length)  # many paths of one hash
        listing = fx.inventory(spark, data)
        again = co.existing_files(queries._files(spark, data, queries.FILES), listing.unionByName(listing))
        assert sorted(map(tuple, again.collect())) == wanted and len(wanted) > 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sources_are_grouped_as_bits(spark, data):
    manifest, found = fx.manifest(spark, data), queries._existing(spark, data)
    assert "collect_set" not in plan(queries.QUERIES["profile_by_platform"](spark, data))
    for profiles in (cen.row_profiles, cen.union_profiles):
        assert sorted(map(str, profiles(manifest, found, queries.FILES).collect())) == sorted(
            map(str, profiles(manifest, found).collect()))


def test_the_listing_names_a_path_once(spark, data):
    listing = fx.inventory(spark, data)
    assert listing.count() == listing.distinct().count() > 1000
    assert "Exchange" not in plan(listing).split("HashAggregate")[0]
