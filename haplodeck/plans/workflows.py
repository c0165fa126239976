"""The analyses end to end: tables in, named result tables out. Nothing runs until a result is
written or read, apart from the ordered steps, which write to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.operators import (
    association as assoc, callset as cs, catalogue as cat, cohort as co, concordance as cc,
    confidence as cf, models as md,
)

METHODS = {"base": ("base_1", "base_2"), "sr": ("sr_1", "sr_2")}
LR, ASM = ("lr_1", "lr_2"), ("asm_1", "asm_2")


def cohort_selection(manifest: DataFrame, inventory: DataFrame, cram: DataFrame, ancestry: DataFrame,
                     columns: list[str], bucket: str, rejected: str | None = None,
                     per_group: int = 10, groups: list[str] = domain.GROUPS) -> dict[str, DataFrame]:
    """Usable long-read file per person, joined with CRAM and ancestry, first n per group."""
    files = co.manifest_files(manifest, columns, bucket, rejected)
    rows = co.resolved_source(manifest, files, inventory)
    eligible = co.eligible_people(co.one_row_per_person(rows), cram, ancestry, bucket, rejected)
    return {
        "source_counts": co.source_counts(rows),
        "eligible": eligible,
        "availability": co.availability(eligible, per_group, groups),
        "other_labels": co.labels_outside(eligible, groups),
        "cohort": co.pick_per_group(eligible, per_group, groups),
    }


def concordance_report(log: DataFrame, people: DataFrame, run_label: str, truth: cc.Pair = LR,
                       methods: dict[str, cc.Pair] = METHODS, cut_new: bool = True,
                       groups: list[str] | None = None, tiebreak: list[str] = ()) -> dict[str, DataFrame]:
    """Field cascade, tiers and three-way agreement of the methods against one truth."""
    rows = cc.load_latest(log, run_label, people, tiebreak=tiebreak)
    counts = cc.cascade_by_method(rows, methods, truth, groups=groups, cut_new=cut_new)
    depths = cc.method_max_depth(rows, methods, cut_new)
    a, b = list(methods.values())[:2]
    return {
        "missing_people": people.join(rows.select("person_id").distinct(), "person_id", "left_anti"),
        "cascade_counts": counts,
        "pooled": cc.mark_structural_cap(cc.pool_counts(counts), depths),
        "field2_by_group": cc.with_rates(counts.where("field_level = 2")),
        "tiers": cc.resolution_tiers(rows, methods, truth),
        "threeway": cc.threeway_concordance(
            rows, a, b, truth, ("lr_identity_1", "lr_identity_2"), ("lr_tied_1", "lr_tied_2")),
    }


def confidence_report(log: DataFrame, people: DataFrame, asm_calls: DataFrame, annotations: DataFrame,
                      run_label: str, min_identity: float, max_distance: float,
                      tiebreak: list[str] = ()) -> dict[str, DataFrame]:
    """Both truth sources at one global confidence bar each. The thresholds have no defaults."""
    rows = cf.assemble(cc.load_latest(log, run_label, people, tiebreak=tiebreak), asm_calls, annotations)
    n_slots = people.count() * len(domain.GENES)
    evidence = cf.annotation_evidence(annotations)
    return {
        "labels": cf.label_counts(rows),
        "identity_sweep": cf.threshold_sweep(cf.identity_values(rows), domain.IDENTITY_SWEEP, "below"),
        "distance_sweep": cf.threshold_sweep(cf.distance_values(evidence), domain.DISTANCE_SWEEP, "above"),
        "retention": cf.retention_stages(cf.truth_scores(rows, min_identity, max_distance), n_slots),
        "rates": cf.confidence_matched_rates(rows, METHODS, min_identity, max_distance),
        "before_after": cf.before_after(rows, min_identity, max_distance),
    }


def callset_report(calls: DataFrame, catalogue: DataFrame, history: DataFrame | None = None
                   ) -> dict[str, DataFrame]:
    """Completeness, diversity, frequencies and catalogue coverage of one callset."""
    freq = cs.allele_frequency(calls)
    missing = cs.locus_missingness(calls)
    out = {
        "missingness": missing, "hardest_loci": cs.hardest_loci(missing),
        "depths": cs.depth_distribution(calls), "fully_resolved": cs.fully_resolved(calls),
        "diversity": cs.allele_diversity(calls), "top_alleles": cs.allele_list(cs.top_alleles(calls)),
        "hwe": cs.hwe_proxy(calls), "frequency": freq,
        "coverage": cat.coverage(calls, catalogue), "tree": cat.allele_tree(calls, catalogue),
        "dominance": cat.enriched_dominance(freq),
    }
    if history is not None:
        out["release_lower_bound"] = cat.release_lower_bound(calls, history, catalogue)
    return out


def association_report(calls: DataFrame, people: DataFrame, disease: str, uncallable: str = "exclude",
                       folds: int = 5, max_iter: int = md.MAX_ITER) -> dict[str, DataFrame]:
    """Marker control check and the untargeted model. people: person_id, ancestry, case. With too
    few cases only the control check is returned."""
    carriers = assoc.marker_carriers(calls, domain.RISK_MARKERS[disease], uncallable)
    out = {"control_check": assoc.fisher_exact(assoc.contingency(carriers.join(people, "person_id")))}
    names = md.feature_names(calls, people)
    matrix = md.feature_matrix(md.feature_tokens(calls, people), names)
    try:
        scores = md.out_of_fold_scores(md.stratified_folds(matrix, folds), folds, max_iter=max_iter)
    except md.TooFewCases:
        return out
    table = md.coefficients(matrix, names, max_iter=max_iter)
    return out | {
        "scores": scores, "ranking": assoc.ranking_metrics(scores), "deciles": assoc.risk_deciles(scores),
        "thresholds": assoc.threshold_metrics(scores, [0.05, 0.10]),
        "group_thresholds": assoc.threshold_metrics(scores, [0.10], "ancestry"),
        "coefficients": table, "top_coefficients": md.top_coefficients(table),
        "nonzero": md.nonzero_count(table),
    }


def people_table(people: DataFrame, phenotype: DataFrame) -> DataFrame:
    """person_id, ancestry, case with null for unlabelled people."""
    return assoc.attach_phenotype(people.select("person_id", F.col("ancestry")), phenotype)
