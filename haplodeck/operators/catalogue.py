"""Observed alleles against a catalogue, its release history, and group enrichment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions import alleles as al
from haplodeck.functions.text import pct
from haplodeck.operators.rows import first_per_key, with_once


def observed_alleles(calls: DataFrame, levels: list[int] = (2, 3)) -> DataFrame:
    """Distinct (gene, field_level, allele); each haplotype counts on its own."""
    entries = F.array(*[
        F.struct(F.lit(n).alias("field_level"), al.truncate_fields(a, n).alias("allele"))
        for n in levels for a in ("a1", "a2")
    ])
    return calls.select("gene", F.explode(entries).alias("_e")).select("gene", "_e.*").where(
        F.col("allele").isNotNull()).distinct()


def catalogued_alleles(catalogue: DataFrame, levels: list[int] = (2, 3)) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(n).alias("field_level"),
                 al.truncate_fields("allele_full", n).alias("allele")) for n in levels
    ])
    return catalogue.select("gene", F.explode(entries).alias("_e")).select("gene", "_e.*").where(
        F.col("allele").isNotNull()).distinct()


def _side_by_side(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    keys = ["gene", "field_level", "allele"]
    obs = observed_alleles(calls).withColumn("_obs", F.lit(1))
    cat = catalogued_alleles(catalogue).withColumn("_cat", F.lit(1))
    return cat.join(obs, keys, "full_outer")


def coverage(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogued, observed, common and uncatalogued alleles per gene and level."""
    out = _side_by_side(calls, catalogue).groupBy("gene", "field_level").agg(
        F.count("_cat").alias("n_catalogued"), F.count("_obs").alias("n_observed"),
        F.count_if(F.col("_cat").isNotNull() & F.col("_obs").isNotNull()).alias("n_common"),
        F.count_if(F.col("_cat").isNull()).alias("n_observed_not_catalogued"),
    )
    return out.withColumn("coverage_pct", pct(F.col("n_common"), F.col("n_catalogued")))


def uncatalogued(calls: DataFrame, catalogue: DataFrame, level: int = 2) -> DataFrame:
    """Observed alleles the catalogue does not name."""
    return observed_alleles(calls, [level]).join(
        catalogued_alleles(catalogue, [level]), ["gene", "field_level", "allele"], "left_anti")


def group_variants(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Three-field variants under every observed two-field group, catalogued and observed."""
    sides = _side_by_side(calls, catalogue)
    groups = sides.where((F.col("field_level") == 2) & F.col("_obs").isNotNull()).select(
        "gene", F.col("allele").alias("group_2field"))
    children = sides.where(F.col("field_level") == 3).groupBy(
        "gene", F.substring_index("allele", ":", 2).alias("group_2field")
    ).agg(F.count("_cat").alias("catalogued_3field"), F.count("_obs").alias("observed_3field"))
    return groups.join(children, ["gene", "group_2field"], "left").fillna(
        0, ["catalogued_3field", "observed_3field"])


def carriers(calls: DataFrame) -> DataFrame:
    """People with at least one copy per (gene, group), and the group label most of them have.
    A person counts once per allele because its two keys are made distinct inside the row."""
    keys = F.array_distinct(F.array(al.truncate_fields("a1", 2), al.truncate_fields("a2", 2)))
    counts = calls.select("gene", "ancestry", F.explode(keys).alias("group_2field")).where(
        F.col("group_2field").isNotNull()
    ).groupBy("gene", "group_2field", "ancestry").agg(F.count("*").alias("n"))
    labelled = F.when(F.col("ancestry").isNotNull(), F.col("n"))
    best = F.min(F.when(F.col("ancestry").isNotNull(), F.struct((-F.col("n")).alias("m"), "ancestry")))
    return counts.groupBy("gene", "group_2field").agg(
        F.sum("n").alias("n_individuals"), best.alias("_b"), F.sum(labelled).alias("_lab")
    ).select(
        "gene", "group_2field", "n_individuals", F.col("_b.ancestry").alias("dominant_ancestry"),
        pct(-F.col("_b.m"), F.col("_lab")).alias("dominant_share_pct"),
    )


def allele_tree(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Observed groups with variant counts, carriers and the dominant group label."""
    return group_variants(calls, catalogue).join(
        carriers(calls), ["gene", "group_2field"], "left")


def tree_summary(tree: DataFrame, k: int = 15) -> DataFrame:
    """The k groups per gene with most carriers."""
    return first_per_key(
        tree, ["gene"], [F.col("n_individuals").desc(), F.col("group_2field")], k, "rank")


def fold_tail(tree: DataFrame, k: int = 6) -> DataFrame:
    """Top k groups per gene, the rest summed under 'other'. Ranks the aggregate, which has one
    row per allele group."""
    ranked = tree.withColumn("_rn", F.row_number().over(
        Window.partitionBy("gene").orderBy(F.col("n_individuals").desc(), F.col("group_2field"))))
    label = F.when(F.col("_rn") <= k, F.col("group_2field")).otherwise("other")
    return ranked.groupBy("gene", label.alias("segment")).agg(
        F.sum("n_individuals").alias("n_individuals")).where(F.col("n_individuals") > 0)


RELEASE_CODE = re.compile(r"^\d{3,4}$")


def release_columns(history: DataFrame) -> list[str]:
    """Release-code columns, oldest first; at least two are needed."""
    codes = [c for c in history.columns if RELEASE_CODE.match(c.strip())]
    if len(codes) < 2:
        raise ValueError(f"fewer than two release columns in {history.columns[:10]}")
    return sorted(codes, key=int)


def first_releases(history: DataFrame, id_col: str = "allele_id") -> DataFrame:
    """Oldest release that names each id. The columns are tried oldest first inside the row, so
    the hundred-column block is never turned into rows."""
    tries = [
        F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != ""), F.lit(int(c)))
        for c in release_columns(history)
    ]
    dated = history.select(F.col(id_col).alias("allele_id"), F.coalesce(*tries).alias("release"))
    return with_once(dated, {"release": F.col("release")})


def group_releases(history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Release that introduced each two-field group: the oldest among its ids."""
    named = catalogue.select("allele_id", "gene", al.truncate_fields("allele_full", 2).alias("group_2field"))
    return named.join(first_releases(history), "allele_id").where(
        F.col("release").isNotNull() & F.col("group_2field").isNotNull()
    ).groupBy("gene", "group_2field").agg(F.min("release").alias("release"))


def release_lower_bound(calls: DataFrame, history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Newest release that introduced any group the callset uses."""
    used = observed_alleles(calls, [2]).select("gene", F.col("allele").alias("group_2field"))
    return group_releases(history, catalogue).join(
        used, ["gene", "group_2field"], "left_semi"
    ).agg(F.max("release").alias("release"), F.count("*").alias("n_groups")).withColumn(
        "release_name", al.decode_release(F.col("release").cast("string")))


def enriched_dominance(freq: DataFrame,
                       min_carriers: float = domain.MIN_CARRIERS_FOR_DOMINANCE) -> DataFrame:
    """Per allele the group with the highest within-group frequency among groups with enough
    carriers; without any such group the best of all, flagged as low confidence."""
    enough = F.col("freq") * 2 * F.col("n_individuals") >= min_carriers
    entry = F.struct((-F.col("freq")).alias("m"), "ancestry")
    out = freq.groupBy("gene", "allele").agg(
        F.min(F.when(enough, entry)).alias("_ok"), F.min(entry).alias("_any"),
        F.sum("freq").alias("_sum"),
    )
    best = F.coalesce("_ok", "_any")
    return out.select(
        "gene", "allele", best["ancestry"].alias("dominant_ancestry"),
        (-best["m"] * 100).alias("dominant_freq_pct"),
        pct(-best["m"], F.col("_sum")).alias("relative_share_pct"),
        F.col("_ok").isNull().alias("low_confidence"),
    )


def relative_prevalence(freq: DataFrame, groups: list[str], k: int = 12) -> DataFrame:
    """Top k alleles per gene by carriers; each group's own frequency as a share of the row sum."""
    totals = freq.groupBy("gene", "allele").agg(
        F.sum(F.col("freq") * 2 * F.col("n_individuals")).alias("carriers"))
    top = first_per_key(totals, ["gene"], [F.round("carriers", 3).desc(), F.col("allele")], k, "rank")
    wide = freq.join(top.select("gene", "allele", "rank"), ["gene", "allele"]).groupBy(
        "gene", "allele", "rank").pivot("ancestry", groups).agg(F.sum("freq")).fillna(0.0, groups)
    total = sum(F.col(f"`{g}`") for g in groups)
    return wide.select("gene", "allele", "rank", *[
        pct(F.col(f"`{g}`"), total).alias(g) for g in groups])


def top_within_group(freq: DataFrame, k: int = 5) -> DataFrame:
    """Most common alleles inside each (gene, group)."""
    return first_per_key(freq, ["gene", "ancestry"], [F.col("n").desc(), F.col("allele")], k, "rank")
