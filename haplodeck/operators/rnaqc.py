"""Numeric quality metrics and run timings: missingness, summaries, correlation, histograms."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplodeck.functions.text import pct
from haplodeck.operators.prefix import exact_quantiles


def ratio(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(f"`{num}`"), F.col(f"`{den}`")))


def metrics_long(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ])
    return df.select(*keep, F.explode(cells).alias("_e")).select(*keep, "_e.*")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per metric, all metrics in one aggregate row first."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count(f"`{c}`").alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), (F.col("_n") - F.col(f"`{c}`"))
                              .alias("n_missing")) for c in columns])
    return wide.select("_n", F.explode(rows).alias("_e")).select(
        "_e.*", F.col("_n").alias("n_rows")
    ).withColumn("missing_pct", pct(F.col("n_missing"), F.col("n_rows")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, null included."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear), max per metric."""
    long = metrics_long(df, columns)
    moments = long.where(F.col("value").isNotNull()).groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quart = exact_quantiles(long, ["metric"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quart.drop("n_values"), "metric")


def duration_stats(long: DataFrame, keys: list[str] = ("metric",), short: float = 30.0) -> DataFrame:
    """n, median, mean, range per duration column and how many are suspiciously short."""
    rows = long.where(F.col("value").isNotNull())
    base = rows.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count_if(F.col("value") < short).alias("n_short"),
    )
    med = exact_quantiles(rows, list(keys), "value", {"median": 0.5}).drop("n_values")
    return base.join(med, list(keys))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every pair, rows with either value missing left out pair by pair; one
    aggregate for all pairs."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[
        _corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)
    ])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"),
                             F.col(f"_r{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("metric_a"), F.lit(a).alias("metric_b"),
                                 F.col(f"_r{i}").alias("r")))
    return wide.select(F.explode(F.array(*rows)).alias("_e")).select("_e.*")


def _corr(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.corr(F.when(both, a), F.when(both, b))


def target_correlation(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """r of the target with each metric, strongest first."""
    wide = df.agg(*[_corr(F.col(f"`{target}`"), F.col(f"`{c}`")).alias(f"_r{i}")
                    for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"_r{i}").alias("r"))
                     for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("_e")).select("_e.*").orderBy(
        F.abs("r").desc_nulls_last(), "metric")


def histogram(df: DataFrame, columns: list[str], bins: int = 40) -> DataFrame:
    """Equal-width bins from min to max per metric, the last one closed. The range table has one
    row per metric."""
    long = metrics_long(df, columns).where(F.col("value").isNotNull())
    lo, hi = F.min("value"), F.max("value")
    flat = lo == hi
    ranges = long.groupBy("metric").agg(
        F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(flat, hi + 0.5).otherwise(hi).alias("hi"),
    )
    spot = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return long.join(F.broadcast(ranges), "metric").groupBy(
        "metric", F.least(spot, F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")).select(
        "metric", "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins)
        .alias("bin_start"), "n")


def join_metrics(meta: DataFrame, metrics: DataFrame, meta_id: str, metrics_id: str) -> DataFrame:
    """Inner join of two tables whose id columns have different names."""
    return meta.join(metrics, F.col(meta_id).cast("string") == F.col(metrics_id).cast("string"))


def stage_reached() -> Column:
    """Furthest stage whose timing is present."""
    return (
        F.when(F.col("annotate_seconds").isNotNull(), "reached_annotation")
        .when(F.col("trim_seconds").isNotNull(), "failed_at_trim")
        .when(F.col("lookup_seconds").isNotNull(), "failed_after_lookup")
        .otherwise("failed_at_target_finding")
    )


def stage_counts(timing: DataFrame) -> DataFrame:
    return timing.groupBy(stage_reached().alias("stage")).agg(F.count("*").alias("n"))


def finished_halves(timing: DataFrame) -> DataFrame:
    """People by the number of haplotypes that reached annotation."""
    per = timing.groupBy("person_id").agg(
        F.count("annotate_seconds").alias("halves_done"))
    return per.groupBy("halves_done").agg(F.count("*").alias("n_people"))


def throughput_summary(samples: DataFrame, keys: list[str] = ("concurrency", "threads")) -> DataFrame:
    """Per configuration: wall clock, seconds per person, failures, peak and mean memory use."""
    out = samples.groupBy(*keys).agg(
        (F.max("sec") - F.min("sec")).cast("double").alias("wall_seconds"),
        F.count("*").alias("n_people"), F.sum("failed").alias("n_failed"),
        F.max("mem_used_pct").alias("mem_peak_pct"), F.avg("mem_used_pct").alias("mem_mean_pct"),
    )
    return out.withColumns({
        "seconds_per_person": F.try_divide(F.col("wall_seconds"), F.col("n_people")),
        "people_per_hour": F.try_divide(F.col("n_people") * 3600.0, F.col("wall_seconds")),
    })


def migrate_results(*versions: DataFrame) -> DataFrame:
    """Results of older layouts in the newest one: threads default to 1, total cores to the
    concurrency, mean memory to the peak."""
    rows = versions[0]
    for v in versions[1:]:
        rows = rows.unionByName(v, allowMissingColumns=True)
    for name in ("threads_per_person", "total_cores", "mem_used_mean_pct"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    threads = F.coalesce(F.col("threads_per_person").cast("int"), F.lit(1))
    return rows.withColumns({
        "threads_per_person": threads,
        "total_cores": F.coalesce(F.col("total_cores").cast("int"), F.col("concurrency") * threads),
        "mem_used_mean_pct": F.coalesce("mem_used_mean_pct", "mem_used_peak_pct"),
    })
