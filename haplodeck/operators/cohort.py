"""Cohort building from manifests and a bucket listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions.text import group_label, pct
from haplodeck.functions.uris import relative_path
from haplodeck.operators.rows import first_per_key, membership


def manifest_files(manifest: DataFrame, columns: list[str], bucket: str,
                   rejected: str | None = None) -> DataFrame:
    """Manifest cells as rows: row_id, person_id, priority, source, uri, path. Cells that cannot
    lie in the bucket are gone, so the existence join below never meets a null path."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("priority"), F.lit(c).alias("source"), F.col(c).alias("uri"),
                 relative_path(c, bucket, rejected).alias("path"))
        for i, c in enumerate(columns)
    ])
    return manifest.select("row_id", "person_id", F.explode(cells).alias("_c")).select(
        "row_id", "person_id", "_c.*").where(F.col("path").isNotNull())


def existing_files(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Cells whose path is in the bucket listing, which may name a path more than once. Paths share long
    beginnings, so the join sorts by their hash alone, a number; paths of one hash are told apart by their
    text, compared both ways so that it becomes no second sort key."""
    listed = inventory.select(F.col("path").alias("_listed"))
    same = (F.col("path") <= F.col("_listed")) & (F.col("path") >= F.col("_listed"))
    return files.join(listed, (F.xxhash64("path") == F.xxhash64("_listed")) & same, "left_semi")


def resolved_source(manifest: DataFrame, files: DataFrame, inventory: DataFrame,
                    none_label: str = "no_existing_file_found") -> DataFrame:
    """Per manifest row the first column, in priority order, whose file exists."""
    best = first_per_key(existing_files(files, inventory), ["row_id"], [F.col("priority")]).select(
        "row_id", "source", "path")
    return manifest.join(best, "row_id", "left").withColumn(
        "source", F.coalesce("source", F.lit(none_label)))


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"))


def one_row_per_person(rows: DataFrame, order: list[str] = ("center", "platform", "row_id")) -> DataFrame:
    """First usable row of every person."""
    usable = rows.where(F.col("path").isNotNull())
    return first_per_key(usable, ["person_id"], [F.col(o) for o in order])


def eligible_people(long_read: DataFrame, cram: DataFrame, groups: DataFrame, bucket: str,
                    rejected: str | None = None) -> DataFrame:
    """People with a usable long-read file, a CRAM in the bucket and a group label."""
    crams = cram.select("person_id", relative_path("cram_uri", bucket, rejected).alias("cram_path"))
    crams = crams.where(F.col("cram_path").isNotNull()).groupBy("person_id").agg(
        F.min("cram_path").alias("cram_path"))
    labels = groups.select("person_id", group_label("ancestry").alias("ancestry"))
    return (
        long_read.select("person_id", F.col("path").alias("lr_path"), "source")
        .join(crams, "person_id").join(labels, "person_id")
        .select("person_id", "ancestry", "cram_path", "lr_path", "source")
    )


def pick_per_group(eligible: DataFrame, n: int, groups: list[str] | None = None) -> DataFrame:
    """The first n people of every group by id."""
    pool = eligible.where(F.col("ancestry").isin(groups)) if groups else eligible
    return first_per_key(pool, ["ancestry"], [F.col("person_id")], n)


def availability(eligible: DataFrame, n: int, groups: list[str]) -> DataFrame:
    """Eligible and picked per wanted group, short groups and absent groups included."""
    spark = eligible.sparkSession
    wanted = spark.createDataFrame([(g,) for g in groups], "ancestry string")
    counts = eligible.groupBy("ancestry").agg(F.count("*").alias("n_eligible"))
    return wanted.join(counts, "ancestry", "left").select(
        "ancestry", F.coalesce("n_eligible", F.lit(0)).alias("n_eligible")
    ).withColumns({
        "n_picked": F.least(F.col("n_eligible"), F.lit(n)), "short": F.col("n_eligible") < n,
    })


def labels_outside(eligible: DataFrame, groups: list[str]) -> DataFrame:
    """Group labels present in the data but not among the wanted ones."""
    return eligible.select("ancestry").distinct().where(~F.col("ancestry").isin(groups))


def overlap_flags(sets: dict[str, DataFrame], key: str = "person_id") -> DataFrame:
    return membership(sets, key)


def venn_regions(flags: DataFrame) -> DataFrame:
    """People per combination of the has_* flags."""
    cols = [c for c in flags.columns if c.startswith("has_")]
    return flags.groupBy(*cols).agg(F.count("*").alias("n"))


def venn_totals(regions: DataFrame) -> DataFrame:
    """Set sizes and the overlaps of the last set with the others."""
    cols = [c for c in regions.columns if c.startswith("has_")]
    a, b, c = (F.col(x) for x in cols)

    def n(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return regions.agg(
        *[n(F.col(x)).alias(f"total_{x[4:]}") for x in cols], n(F.lit(True)).alias("total_any"),
        n(c & b).alias(f"{cols[2][4:]}_and_{cols[1][4:]}"),
        n(c & (a | b)).alias(f"{cols[2][4:]}_and_either"),
    )


def group_progress(people: DataFrame, done: DataFrame, group: str = "ancestry") -> DataFrame:
    """Total and finished people per group."""
    hit = done.select("person_id", F.lit(1).alias("_d")).distinct()
    return people.withColumn(group, F.coalesce(group, F.lit("NA"))).join(
        hit, "person_id", "left"
    ).groupBy(group).agg(F.count("*").alias("n_total"), F.count("_d").alias("n_done"))


def run_totals(people: DataFrame, done: DataFrame, given_up: DataFrame) -> DataFrame:
    """Done, given up and remaining; done wins over given up."""
    d = done.select("person_id", F.lit(1).alias("_d")).distinct()
    g = given_up.select("person_id", F.lit(1).alias("_g")).distinct()
    joined = people.join(d, "person_id", "left").join(g, "person_id", "left")
    gave = F.col("_d").isNull() & F.col("_g").isNotNull()
    return joined.agg(
        F.count("_d").alias("n_done"), F.count_if(gave).alias("n_given_up"),
        F.count_if(F.col("_d").isNull() & F.col("_g").isNull()).alias("n_remaining"),
    )


def tier_group_distribution(people: DataFrame, tier: str) -> DataFrame:
    """Group shares inside one tier: who would be excluded with it."""
    counts = people.where(F.col("trim_tier") == tier).groupBy(
        F.coalesce("ancestry", F.lit("NA")).alias("ancestry")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per group label
    return counts.select("ancestry", "n", pct(F.col("n"), total).alias("n_pct"))


def call_completeness(gene_calls: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    """Called haplotype slots and genes with any call, per sample."""
    from haplodeck.functions.text import is_null_token

    rows = gene_calls.where(F.col("gene").isin(genes))
    ok1, ok2 = ~is_null_token("call_1"), ~is_null_token("call_2")
    return rows.groupBy("person_id").agg(
        F.sum(ok1.cast("int") + ok2.cast("int")).alias("called_slots"),
        F.count_if(ok1 | ok2).alias("called_genes"),
    )
