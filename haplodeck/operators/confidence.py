"""Call confidence: labels, sweeps, retention, and comparison at matched confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions import alleles as al
from haplodeck.functions.text import both_or_null, pct, to_double, truthy
from haplodeck.operators import concordance as cc
from haplodeck.operators.prefix import exact_quantiles, global_rank
from haplodeck.operators.rows import with_once
from haplodeck.operators.selection import first_k, key_order
from haplodeck.session import cut_lineage

LR, ASM = ("lr_1", "lr_2"), ("asm_1", "asm_2")
TOOLS = ["asm", "lr"]


def long_read_evidence() -> dict[str, Column]:
    """Worst identity of the two haplotypes (null unless both parse) and the either-tied flag."""
    id1, id2 = to_double("lr_identity_1"), to_double("lr_identity_2")
    return {
        "lr_worst_identity": both_or_null(id1, id2, F.least(id1, id2)),
        "lr_tied": truthy("lr_tied_1") | truthy("lr_tied_2"),
    }


def annotation_evidence(annotations: DataFrame) -> DataFrame:
    """Worst distance over the haplotypes that report one, and any real warning."""
    warned = ~F.upper(F.trim(F.coalesce("template_warning", F.lit("NA")))).isin("NA", "")
    return annotations.groupBy("person_id", "gene").agg(
        F.max(to_double("template_distance")).alias("asm_worst_distance"),
        F.bool_or(warned).alias("asm_warning"),
    )


def _with_slots(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Left join by person and gene. The gene is compared by order, so that rows spread by person stay where they
    are: an equality would be taken as a second key to shuffle by. A person has few genes."""
    other = other.withColumnsRenamed({"person_id": "_person", "gene": "_gene"})
    gene = (F.col("gene") <= F.col("_gene")) & (F.col("gene") >= F.col("_gene"))
    return rows.join(other, (F.col("person_id") == F.col("_person")) & gene, "left").drop("_person", "_gene")


def assemble(log_rows: DataFrame, asm_calls: DataFrame, annotations: DataFrame, bare: bool = False) -> DataFrame:
    """Log rows with long-read evidence, assembly calls and assembly evidence. Only keys of the
    log survive. `bare` says that the calls' genes have no prefix, so a table stored by gene keeps its layout."""
    calls = asm_calls.select("person_id", "gene" if bare else al.bare_gene("gene").alias("gene"), *ASM)
    rows = with_once(log_rows, long_read_evidence())
    for other in (calls, annotation_evidence(annotations)):
        rows = rows.join(other, ["person_id", "gene"], "left") if bare else _with_slots(rows, other)
    return rows.withColumn("asm_warning", F.coalesce("asm_warning", F.lit(False)))


def lr_confident(min_identity: float) -> Column:
    return F.coalesce(~F.col("lr_tied") & (F.col("lr_worst_identity") >= min_identity), F.lit(False))


def asm_confident(max_distance: float) -> Column:
    return F.coalesce(
        ~F.col("asm_warning") & (F.col("asm_worst_distance") <= max_distance), F.lit(False)
    )


def confidence_label(min_identity: float = domain.CONFIDENT_IDENTITY) -> Column:
    """unknown / ambiguous(tied) / confident / lower_identity, in that order of precedence."""
    worst = F.col("lr_worst_identity")
    return (
        F.when(worst.isNull(), "unknown").when(F.col("lr_tied"), "ambiguous(tied)")
        .when(worst >= min_identity, "confident").otherwise("lower_identity")
    )


def label_counts(rows: DataFrame, min_identity: float = domain.CONFIDENT_IDENTITY) -> DataFrame:
    """Confidence labels per gene."""
    return rows.groupBy("gene", confidence_label(min_identity).alias("label")).agg(
        F.count("*").alias("n")
    )


def annotation_summary(annotations: DataFrame) -> DataFrame:
    """Per gene: haplotypes with a distance, their mean distance, haplotypes with a warning."""
    d = to_double("template_distance")
    w = F.trim(F.coalesce("template_warning", F.lit("NA")))
    return annotations.groupBy("gene").agg(
        F.count(d).alias("n_distance"), F.avg(d).alias("mean_distance"),
        F.count_if((w != "") & (w != "NA")).alias("n_warned"),
    )


def threshold_sweep(values: DataFrame, thresholds: list[float], exclude: str) -> DataFrame:
    """Share of values per gene that each threshold would exclude ('below' or 'above' it)."""
    def out_of(t: float) -> Column:
        return F.col("value") < t if exclude == "below" else F.col("value") > t

    counts = values.where(F.col("value").isNotNull()).groupBy("gene").agg(
        F.count("*").alias("n_values"),
        *[F.count_if(out_of(t)).alias(f"_x{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_x{i}").alias("n_excluded"))
        for i, t in enumerate(thresholds)
    ])
    return counts.withColumn("_r", F.explode(rows)).select("gene", "n_values", "_r.*").withColumn(
        "excluded_pct", pct(F.col("n_excluded"), F.col("n_values"))
    )


def identity_values(rows: DataFrame) -> DataFrame:
    """Worst identities of untied calls; tied calls have no meaningful identity."""
    return rows.where(~F.col("lr_tied")).select("gene", F.col("lr_worst_identity").alias("value"))


def distance_values(evidence: DataFrame) -> DataFrame:
    """Worst distances, warned calls included."""
    return evidence.select("gene", F.col("asm_worst_distance").alias("value"))


def upper_median(values: DataFrame) -> DataFrame:
    """Element at position n // 2 of each gene's sorted values."""
    return exact_quantiles(values, ["gene"], "value", {}, {"median": 0.5})


def truth_scores(rows: DataFrame, min_identity: float, max_distance: float) -> DataFrame:
    """One row per slot and truth source that resolves it: tool, passes, score (higher is surer).
    Thresholds have no defaults on purpose."""
    flagged = with_once(rows, {
        "_lr": al.resolved(*LR), "_asm": al.resolved(*ASM),
        "_lr_ok": lr_confident(min_identity), "_asm_ok": asm_confident(max_distance),
    })
    entries = F.array(
        F.struct(F.lit("lr").alias("tool"), F.col("_lr").alias("resolved"),
                 F.col("_lr_ok").alias("passes"), F.col("lr_worst_identity").alias("score")),
        F.struct(F.lit("asm").alias("tool"), F.col("_asm").alias("resolved"),
                 F.col("_asm_ok").alias("passes"), (-F.col("asm_worst_distance")).alias("score")),
    )
    return flagged.select("person_id", "gene", F.explode(entries).alias("_e")).select(
        "person_id", "gene", "_e.*"
    ).where("resolved")


def rank_trim_match(scores: DataFrame) -> DataFrame:
    """Equal-size sets with ranks: both tools' passing slots cut to the size of the smaller set, the surest
    kept, ties by (person, gene). One range-partitioned ordering serves both tools: it sorts by
    tool first, so a tool's rank is the global rank less the rows of the tools before it. The narrow rows
    are written before they are sampled and ordered. Where ranks are not needed see `matched_slots`."""
    passing = cut_lineage(scores.where("passes").select("person_id", "gene", "tool", "score"))
    ranked = global_rank(
        passing, [F.col("tool"), F.col("score").desc(), F.col("person_id"), F.col("gene")], "_rank"
    )
    sizes = passing.agg(F.count_if(F.col("tool") == "asm").alias("n_asm"), F.count_if(F.col("tool") == "lr").alias("n_lr"))
    in_tool = F.when(F.col("tool") == "asm", F.col("_rank")).otherwise(
        F.col("_rank") - sizes.select("n_asm").scalar())
    return ranked.withColumn("rank", in_tool).where(
        F.col("rank") <= sizes.select(F.least("n_asm", "n_lr")).scalar()).drop("_rank")


def matched_slots(scores: DataFrame) -> DataFrame:
    """The rows of `rank_trim_match` without their ranks, chosen by selection: no table is ordered. Reads
    `scores` several times, so give them written."""
    passing = scores.where("passes").select("person_id", "gene", "tool", "score").withColumn("_down", -F.col("score"))
    sizes = passing.agg(*[F.count_if(F.col("tool") == t) for t in TOOLS]).first()
    passing, person = key_order(passing, "person_id")
    return first_k(passing, "tool", {t: min(sizes) for t in TOOLS}, ["_down", person], ["person_id", "gene"]).select(
        "person_id", "gene", "tool", "score")


def retention_stages(scores: DataFrame, n_slots: int | Column) -> DataFrame:
    """Slots per gene and tool: resolved, past the bar, past size matching; each also as a share
    of the one common denominator. The narrow score rows are written once; counting and selecting
    read them."""
    scores = cut_lineage(scores)
    matched = matched_slots(scores).groupBy("gene", "tool").agg(F.count("*").alias("after_matching"))
    out = scores.groupBy("gene", "tool").agg(
        F.count("*").alias("all_resolved"),
        F.count_if("passes").alias("after_threshold"),
    ).join(matched, ["gene", "tool"], "left").withColumn("after_matching", F.coalesce("after_matching", F.lit(0)))
    total = cc.with_total(out, ["tool"], "gene", ["all_resolved", "after_threshold", "after_matching"])
    slots = F.lit(n_slots) if isinstance(n_slots, int) else n_slots
    return total.withColumns({
        f"{c}_slot_pct": pct(F.col(c), slots)
        for c in ("all_resolved", "after_threshold", "after_matching")
    })


def confidence_matched_rates(rows: DataFrame, methods: dict[str, cc.Pair], min_identity: float,
                             max_distance: float, levels: list[int] = (1, 2)) -> DataFrame:
    """Both truth sources, before and after confidence matching: counts and match rate per truth,
    scenario, gene, method and level."""
    matched = matched_slots(cut_lineage(truth_scores(rows, min_identity, max_distance)))
    kept = matched.groupBy("person_id").agg(F.collect_set(F.struct("gene", "tool")).alias("_kept"))  # genes times tools
    flagged = rows.join(kept, "person_id", "left")  # by person, as the rows lie
    truths = F.array(*[
        F.struct(F.lit(t).alias("truth"), F.col(p[0]).alias("truth_1"), F.col(p[1]).alias("truth_2"),
                 F.coalesce(F.array_contains("_kept", F.struct("gene", F.lit(t).alias("tool"))), F.lit(False))
                 .alias("matched"))
        for t, p in (("lr", LR), ("asm", ASM))
    ])
    calls = [c for pair in methods.values() for c in pair]
    stacked = flagged.select("gene", *calls, F.explode(truths).alias("_t")).select(
        "gene", *calls, "_t.*")
    counts = cc.cascade_by_method(
        stacked, methods, ("truth_1", "truth_2"), keys=["truth", "gene", "matched"]
    ).where(F.col("field_level").isin(list(levels)))
    both = F.array(F.lit("unfiltered"), F.lit("matched"))
    scenarios = counts.withColumn("scenario", F.explode(
        F.when(F.col("matched"), both).otherwise(F.array(F.lit("unfiltered")))))
    return cc.pool_counts(scenarios, ["truth", "scenario", "gene", "method", "field_level"])


def before_after(rows: DataFrame, min_identity: float, max_distance: float,
                 level: int = 2) -> DataFrame:
    """The two truth sources against each other on slots both resolve: retention counts and
    concordance before and after asking both for confidence, per gene and ALL."""
    both = cc.with_cascade(rows, ASM, LR).where(F.col("casc_t1").isNotNull())
    status = cc.genotype_status("casc", level)
    lr_ok, asm_ok = lr_confident(min_identity), asm_confident(max_distance)
    sure = lr_ok & asm_ok
    sums = {
        "n_resolved": F.count("*"), "n_lr_confident": F.count_if(lr_ok),
        "n_asm_confident": F.count_if(asm_ok), "n_both_confident": F.count_if(sure),
        "concordant_before": F.count_if(status == "concordant"),
        "discordant_before": F.count_if(status == "discordant"),
        "concordant_after": F.count_if(sure & (status == "concordant")),
        "discordant_after": F.count_if(sure & (status == "discordant")),
    }
    counts = both.groupBy("gene").agg(*[e.alias(n) for n, e in sums.items()])
    total = cc.with_total(counts, [], "gene", list(sums))
    return total.withColumns({
        f"pct_{w}": pct(F.col(f"concordant_{w}"),
                        F.col(f"concordant_{w}") + F.col(f"discordant_{w}"))
        for w in ("before", "after")
    })
