"""Completeness, diversity and frequency of one callset, without any truth set.

Input is long: person_id, gene, a1, a2 and, where groups are wanted, ancestry. Every operator is
one scan and one partial aggregate on (gene[, ancestry][, allele]); shares are taken on the small
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions import alleles as al
from haplodeck.functions.text import pct, reader_missing, share
from haplodeck.operators.rows import first_per_key, with_once


def genotypes_long(wide: DataFrame, genes: list[str] = domain.GENES, id_col: str = "research_id",
                   keep: list[str] = (), allow_missing: bool = False) -> DataFrame:
    """<gene>_1 / <gene>_2 columns -> one row per (person, gene). A gene without both columns is an
    error, or is left out if the caller allows it."""
    absent = [c for g in genes for c in (f"{g}_1", f"{g}_2") if c not in wide.columns]
    if absent and not allow_missing:
        raise ValueError(f"columns not found: {', '.join(absent)}")
    have = [g for g in genes if f"{g}_1" not in absent and f"{g}_2" not in absent]
    if not have:
        raise ValueError(f"no <gene>_1/<gene>_2 columns among {wide.columns}")
    entries = [
        F.struct(F.lit(g).alias("gene"), F.col(f"{g}_1").alias("a1"), F.col(f"{g}_2").alias("a2"))
        for g in have
    ]
    return wide.select(
        F.col(id_col).alias("person_id"), *keep, F.explode(F.array(*entries)).alias("_e")
    ).select("person_id", *keep, "_e.*")


def genotypes_wide(long: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    return long.groupBy("person_id").agg(*[
        F.max(F.when(F.col("gene") == g, F.col(a))).alias(f"{g}_{i}")
        for g in genes for i, a in ((1, "a1"), (2, "a2"))
    ])


def join_group(calls: DataFrame, groups: DataFrame, how: str = "left") -> DataFrame:
    """Genotypes with the person's group label; 'inner' keeps labelled people only."""
    return calls.join(groups.select("person_id", "ancestry"), "person_id", how)


def matched_people(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """How many people of the callset carry a group label."""
    people = calls.select("person_id").distinct()
    labelled = groups.select("person_id", F.lit(1).alias("_hit")).distinct()
    return people.join(labelled, "person_id", "left").agg(
        F.count("_hit").alias("n_matched"), F.count("*").alias("n_total")
    )


def locus_missingness(calls: DataFrame, keys: list[str] = ("gene",)) -> DataFrame:
    """Missing-either, missing-both and homozygosity of the raw text among resolved rows."""
    m1, m2 = reader_missing("a1"), reader_missing("a2")
    either = m1 | m2
    out = calls.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.count_if(either).alias("n_missing_either"),
        F.count_if(m1 & m2).alias("n_missing_both"),
        F.count_if(~either & (F.col("a1") == F.col("a2"))).alias("n_homozygous"),
    )
    resolved = F.col("n_total") - F.col("n_missing_either")
    return out.withColumns({
        "n_resolved": resolved,
        "missing_either_pct": pct(F.col("n_missing_either"), F.col("n_total")),
        "missing_both_pct": pct(F.col("n_missing_both"), F.col("n_total")),
        "homozygosity_pct": pct(F.col("n_homozygous"), resolved),
    })


def hardest_loci(missingness: DataFrame, hardest: list[str] = domain.HARDEST_LOCI) -> DataFrame:
    """Mean missing-either rate of the hard loci against all others."""
    hard = F.col("gene").isin(hardest)
    return missingness.agg(
        F.avg(F.when(hard, F.col("missing_either_pct"))).alias("hardest_pct"),
        F.avg(F.when(~hard, F.col("missing_either_pct"))).alias("others_pct"),
    ).withColumn("hardest_is_worse", F.col("hardest_pct") > F.col("others_pct"))


def depth_distribution(calls: DataFrame) -> DataFrame:
    """Field depth of the calls of fully resolved rows, share within the gene."""
    ok = calls.where(~reader_missing("a1") & ~reader_missing("a2"))
    stacked = ok.select("gene", F.explode(F.array(al.raw_depth("a1"), al.raw_depth("a2")))
                        .alias("depth")).where(F.col("depth").isNotNull())
    counts = stacked.groupBy("gene", "depth").agg(F.count("*").alias("n"))
    return counts.withColumn(
        "share_pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy("gene")))
    )


def fully_resolved(calls: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    """People with both alleles present at every gene."""
    ok = ~reader_missing("a1") & ~reader_missing("a2")
    per_person = calls.where(F.col("gene").isin(genes)).groupBy("person_id").agg(
        F.count_if(ok).alias("n_ok")
    )
    return per_person.agg(
        F.count("*").alias("n_people"),
        F.count_if(F.col("n_ok") == len(genes)).alias("n_fully_resolved"),
    ).withColumn("fully_resolved_pct", pct(F.col("n_fully_resolved"), F.col("n_people")))


def group_composition(people: DataFrame, group: str = "ancestry") -> DataFrame:
    """Group sizes and shares, people without a label included."""
    counts = people.groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn("n_pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy())))


def _both_callable(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, allele, hom): two rows per genotype whose haplotypes both have two fields."""
    k1, k2 = al.two_field("a1", any_case=True), al.two_field("a2", any_case=True)
    keyed = with_once(calls.select(*keys, "a1", "a2"), {"_k1": k1, "_k2": k2}).where(
        F.col("_k1").isNotNull() & F.col("_k2").isNotNull()
    )
    return keyed.select(
        *keys, (F.col("_k1") == F.col("_k2")).cast("long").alias("hom"),
        F.explode(F.array("_k1", "_k2")).alias("allele"),
    )


def allele_frequency(calls: DataFrame, keys: list[str] = ("gene", "ancestry")) -> DataFrame:
    """Two-field allele counts and frequencies per key, with the callable individuals."""
    keys = list(keys)
    counts = _both_callable(calls, keys).dropna(subset=keys).groupBy(*keys, "allele").agg(
        F.count("*").alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumns({
        "freq": share(F.col("n"), total), "n_individuals": (total / 2).cast("long"),
    })


def allele_diversity(calls: DataFrame, rare: float = domain.RARE_FREQUENCY) -> DataFrame:
    """Distinct alleles and the share of them below the rare bar, per gene."""
    freq = allele_frequency(calls, ["gene"])
    return freq.groupBy("gene").agg(
        F.max("n_individuals").alias("n_callable"),
        F.count("*").alias("n_distinct"),
        F.count_if(F.col("freq") < rare).alias("n_rare"),
    ).withColumn("rare_share", share(F.col("n_rare"), F.col("n_distinct")))


def hwe_proxy(calls: DataFrame, all_label: str = "ALL") -> DataFrame:
    """Observed against expected homozygosity per gene for every group and pooled. The pooled row
    comes from pooled counts, so people without a label are in it."""
    base = _both_callable(calls, ["gene", "ancestry"]).groupBy("gene", "ancestry", "allele").agg(
        F.count("*").alias("n"), F.sum("hom").alias("hom")
    )
    rolled = base.groupingSets(
        [[F.col("gene"), F.col("ancestry"), F.col("allele")], [F.col("gene"), F.col("allele")]],
        "gene", "ancestry", "allele",
    ).agg(F.grouping("ancestry").alias("_all"), F.sum("n").alias("n"), F.sum("hom").alias("hom"))
    groups = rolled.where((F.col("_all") == 1) | F.col("ancestry").isNotNull()).withColumn(
        "ancestry", F.when(F.col("_all") == 1, all_label).otherwise(F.col("ancestry"))
    )
    total = F.sum("n").over(Window.partitionBy("gene", "_all", "ancestry"))
    p = share(F.col("n"), total)
    out = groups.withColumn("_p2", p * p).groupBy("gene", "_all", "ancestry").agg(
        (F.sum("n") / 2).cast("long").alias("n_individuals"),
        share(F.sum("hom"), F.sum("n")).alias("obs_hom"),
        F.sum("_p2").alias("exp_hom"),
        F.count("*").alias("n_distinct"),
    )
    return out.withColumn("obs_over_exp", F.try_divide("obs_hom", "exp_hom")).drop("_all")


def top_alleles(calls: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent alleles per gene."""
    freq = allele_frequency(calls, ["gene"])
    return first_per_key(freq, ["gene"], [F.col("n").desc(), F.col("allele")], k, "rank").select(
        "gene", "rank", "allele", "n", "freq"
    )


def allele_list(ranked: DataFrame) -> DataFrame:
    """One text per gene out of `top_alleles`, most frequent first."""
    item = F.struct("rank", F.format_string("%s (%.1f)", "allele", F.col("freq") * 100).alias("t"))
    return ranked.groupBy("gene").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ")
        .alias("top_alleles")
    )


def homozygosity_matrix(calls: DataFrame, groups: list[str]) -> DataFrame:
    """Gene rows x group columns of the raw homozygosity rate."""
    stats = locus_missingness(calls, ["gene", "ancestry"])
    return stats.groupBy("gene").pivot("ancestry", groups).agg(F.first("homozygosity_pct"))


def homozygous_locus_count(calls: DataFrame) -> DataFrame:
    """Per person: loci whose two raw calls are the same text."""
    same = ~reader_missing("a1") & ~reader_missing("a2") & (F.col("a1") == F.col("a2"))
    return calls.groupBy("person_id").agg(F.count_if(same).alias("n_homozygous"))


def pca_points(df: DataFrame, text: str | Column, keep: list[str]) -> DataFrame:
    """First two numbers of a list literal; unreadable text gives nulls."""
    c = F.col(text) if isinstance(text, str) else text
    numbers = F.from_json(c, "array<double>", {"mode": "PERMISSIVE"})
    return df.select(*keep, numbers.alias("_pc")).select(
        *keep, F.get("_pc", F.lit(0)).alias("pc1"), F.get("_pc", F.lit(1)).alias("pc2")
    )
