"""Case/control association: marker carriers, contingency tables, exact tests, score metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haplodeck import domain
from haplodeck.functions import alleles as al
from haplodeck.functions.text import share
from haplodeck.operators.prefix import global_rank, grouped_running_totals
from haplodeck.operators.selection import first_k, key_order


def attach_phenotype(people: DataFrame, phenotype: DataFrame) -> DataFrame:
    return people.join(phenotype.select("person_id", "case"), "person_id", "left")


def allele_dosage(calls: DataFrame, alleles: list[tuple[str, str]]) -> DataFrame:
    """Copies of each listed (gene, allele) per person; null when the gene is uncallable."""
    wanted = F.array(*[
        F.struct(F.lit(g).alias("gene"), F.lit(a).alias("allele")) for g, a in alleles
    ])
    mine = F.filter(wanted, lambda w: w["gene"] == F.col("gene"))
    genes = sorted({g for g, _ in alleles})
    rows = calls.where(F.col("gene").isin(genes)).withColumn("_w", F.explode(mine))
    return rows.select(
        "person_id", "gene", F.col("_w.allele").alias("allele"),
        al.dosage("a1", "a2", F.col("_w.allele")).alias("dosage"))


def marker_carriers(calls: DataFrame, markers: list[tuple[str, str, str]],
                    uncallable: str = "exclude") -> DataFrame:
    """Per person whether any marker is carried; a marker is carried when all of its alleles are.

    Every component becomes one conditional column of a single per-person aggregate.
    uncallable='exclude' drops people with an uncallable component, 'noncarrier' counts that
    component as absent."""
    if uncallable not in ("exclude", "noncarrier"):
        raise ValueError(uncallable)
    comps = {
        f"_m{i}": F.max(F.when(F.col("gene") == g, al.dosage("a1", "a2", a)))
        for i, (_, g, a) in enumerate(markers)
    }
    genes = sorted({g for _, g, _ in markers})
    per = calls.where(F.col("gene").isin(genes)).groupBy("person_id").agg(
        *[e.alias(n) for n, e in comps.items()])
    if uncallable == "exclude":
        per = per.dropna(subset=list(comps))
    names: dict[str, list[str]] = {}
    for i, (marker, _, _) in enumerate(markers):
        names.setdefault(marker, []).append(f"_m{i}")
    carrier = F.lit(False)
    for parts in names.values():
        whole = F.lit(True)
        for part in parts:
            whole = whole & (F.coalesce(F.col(part), F.lit(0)) > 0)
        carrier = carrier | whole
    return per.select("person_id", carrier.alias("carrier"))


def contingency(people: DataFrame, group: str = "ancestry", label: str = "ALL") -> DataFrame:
    """2x2 counts and odds ratio, pooled and per group. Degenerate tables (one class or one
    carrier state only) have no odds ratio; a zero b*c gives infinity."""
    car, case = F.col("carrier"), F.col("case")
    base = people.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_if(car & (case == 1)).alias("a"), F.count_if(car & (case == 0)).alias("b"),
        F.count_if(~car & (case == 1)).alias("c"), F.count_if(~car & (case == 0)).alias("d"),
        F.count_if(car).alias("_car"),
    )
    cols = ["n", "a", "b", "c", "d", "_car"]
    rolled = base.groupingSets([[F.col(group)], []], group).agg(
        F.grouping(group).alias("_all"), *[F.sum(x).alias(x) for x in cols])
    rows = rolled.where((F.col("_all") == 1) | F.col(group).isNotNull()).withColumn(
        group, F.when(F.col("_all") == 1, label).otherwise(F.col(group)))
    one_class = (F.col("a") + F.col("c") == 0) | (F.col("b") + F.col("d") == 0)
    degenerate = one_class | (F.col("_car") == 0) | (F.col("_car") == F.col("n"))
    ad = F.col("a").cast("double") * F.col("d")
    bc = F.col("b").cast("double") * F.col("c")
    odds = F.when(bc > 0, ad / bc).when(ad > 0, F.lit(float("inf")))
    return rows.select(
        group, "n", "a", "b", "c", "d", degenerate.alias("degenerate"),
        F.when(~degenerate, odds).alias("odds_ratio"))


def _lgamma(x):
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _log_binom(n, k):
    n = np.asarray(n, dtype=float)
    k = np.asarray(k, dtype=float)
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)


def fisher_two_sided(a: int, b: int, c: int, d: int, slack: float = 1e-7, block: int = 2048) -> float:
    """Two-sided exact p: the sum of all tables with the same margins that are no more probable
    than the observed one. Tables are summed outwards from the observed one and from its mirror
    on the other side of the mode, until a block adds nothing."""
    n, row, col_ = a + b + c + d, a + b, a + c
    lo, hi = max(0, col_ - (n - row)), min(row, col_)
    whole = float(_log_binom(n, col_))

    def logp(x):
        x = np.asarray(x, dtype=float)
        return _log_binom(row, x) + _log_binom(n - row, col_ - x) - whole

    seen = float(logp(a))
    bar = seen + math.log1p(slack)
    mode = min(max(((row + 1) * (col_ + 1)) // (n + 2), lo), hi)
    if float(logp(mode)) <= bar:
        return 1.0

    def edge(inner: int, outer: int) -> int | None:
        """First table from the mode towards `outer` that is not more probable than the bar."""
        if float(logp(outer)) > bar:
            return None
        step = 1 if outer > inner else -1
        left, right = 0, abs(outer - inner)
        while left < right:
            mid = (left + right) // 2
            if float(logp(inner + step * mid)) <= bar:
                right = mid
            else:
                left = mid + 1
        return inner + step * left

    total = 0.0
    for outer in (lo, hi):
        at = edge(mode, outer)
        if at is None:
            continue
        step = 1 if outer >= mode and outer == hi else -1
        left = abs(outer - at) + 1
        while left > 0:
            k = min(block, left)
            part = float(np.exp(logp(at + step * np.arange(k))).sum())
            total += part
            if part <= total * 1e-18:
                break
            at, left = at + step * k, left - k
    return min(total, 1.0)


def _fisher_column(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, t)) for t in zip(a, b, c, d)], dtype="float64")


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Adds the exact two-sided p to contingency rows: one row per group, never per person."""
    test = F.pandas_udf(_fisher_column, T.DoubleType())
    return tables.withColumn("fisher_p", F.when(~F.col("degenerate"), test("a", "b", "c", "d")))


def _with_pooled(scores: DataFrame, group: str, label: str) -> DataFrame:
    """Counts per (group, score) with the pooled rows added. Ties collapse here, before anything
    is ordered."""
    base = scores.groupBy(group, "score").agg(
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    rolled = base.groupingSets([[F.col(group), F.col("score")], [F.col("score")]], group, "score")
    return rolled.agg(
        F.grouping(group).alias("_all"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    ).withColumn(group, F.when(F.col("_all") == 1, label).otherwise(F.col(group))).drop("_all")


def ranking_metrics(scores: DataFrame, group: str = "ancestry", label: str = "ALL",
                    min_cases: int = domain.MIN_GROUP_CASES) -> DataFrame:
    """AUROC (ties count half) and average precision (step rule) per group and pooled, null for
    groups with too few cases or controls. scores: person_id, score, label 0/1, group.

    Both come from one ordered pass of running positive and negative counts over distinct scores.
    """
    hist = _with_pooled(scores, group, label)
    cum = grouped_running_totals(hist, [group], [F.col("score").desc()], ["pos", "neg"])
    size = hist.groupBy(group).agg(F.sum("pos").alias("cases"), F.sum("neg").alias("controls"))
    above = F.col("pos_cum") - F.col("pos")
    wins = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    ap = F.sum(F.col("pos") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum")))
    out = cum.groupBy(group).agg(wins.alias("_w"), ap.alias("_ap")).join(size, group)
    enough = (F.col("cases") >= min_cases) & (F.col("controls") >= min_cases)
    return out.select(
        group, (F.col("cases") + F.col("controls")).alias("n"), "cases",
        F.when(enough, F.try_divide(F.col("_w"), F.col("cases") * F.col("controls").cast("double")))
        .alias("auroc"),
        F.when(enough, F.try_divide(F.col("_ap"), F.col("cases").cast("double"))).alias("auprc"),
    )


def _ranked(scores: DataFrame, group: str | None) -> DataFrame:
    """Rank 1 = highest score, within `group` when given; ties by person."""
    if not group:
        return global_rank(scores, [F.col("score").desc(), F.col("person_id")], "rank", "size")
    ranked = global_rank(scores, [F.col(group), F.col("score").desc(), F.col("person_id")], "_g")
    sizes = ranked.groupBy(group).agg(F.count("*").alias("size"), (F.min("_g") - 1).alias("_before"))
    return ranked.join(sizes, group).withColumn("rank", F.col("_g") - F.col("_before")).drop("_g", "_before")


def risk_deciles(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-count bins by descending score (the first n % bins get one more), with case rate and
    enrichment over the prevalence."""
    ranked = _ranked(scores, None)
    q, r = F.floor(F.col("size") / bins), F.col("size") % bins
    at, wide = F.col("rank") - 1, r * (q + 1)
    tile = F.when(at < wide, F.floor(at / (q + 1)) + 1).otherwise(
        r + F.floor((at - wide) / F.greatest(q, F.lit(1))) + 1)
    bins_df = ranked.groupBy(tile.cast("int").alias("decile")).agg(
        F.count("*").alias("n"), F.sum("label").alias("cases"))
    rate, all_bins = share(F.col("cases"), F.col("n")), Window.partitionBy()  # one row per bin
    prevalence = share(F.sum("cases").over(all_bins), F.sum("n").over(all_bins))
    return bins_df.select("decile", "n", "cases", rate.alias("case_rate"),
                          F.try_divide(rate, prevalence).alias("enrichment"))


def _with_predictive_values(out: DataFrame) -> DataFrame:
    return out.withColumns({
        "ppv": share(F.col("tp"), F.col("tp") + F.col("fp")),
        "sensitivity": share(F.col("tp"), F.col("tp") + F.col("fn")),
        "specificity": share(F.col("tn"), F.col("tn") + F.col("fp")),
        "npv": share(F.col("tn"), F.col("tn") + F.col("fn")),
    })


def threshold_metrics(scores: DataFrame, fractions: list[float], group: str | None = None) -> DataFrame:
    """PPV, sensitivity, specificity and NPV when the top fraction is flagged; the flagged count is
    max(1, round half even of n * fraction)."""
    ranked = _ranked(scores, group)
    keys = [group] if group else []
    rows = None
    entries = F.array(*[
        F.struct(F.lit(f).alias("fraction"),
                 F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(f), 0).cast("long")).alias("k"))
        for f in fractions
    ])
    rows = ranked.withColumn("_e", F.explode(entries)).select(
        *keys, "label", "_e.fraction", "_e.k", (F.col("rank") <= F.col("_e.k")).alias("flag"))
    pos = F.col("label") == 1
    out = rows.groupBy(*keys, "fraction").agg(
        F.max("k").alias("n_flagged"),
        F.count_if(F.col("flag") & pos).alias("tp"), F.count_if(F.col("flag") & ~pos).alias("fp"),
        F.count_if(~F.col("flag") & pos).alias("fn"), F.count_if(~F.col("flag") & ~pos).alias("tn"),
    )
    return _with_predictive_values(out)


def threshold_metrics_selected(scores: DataFrame, fractions: list[float]) -> DataFrame:
    """The pooled `threshold_metrics` by selection of the flagged rows instead of an order of all. Reads
    `scores` several times, so give them written."""
    rows, person = key_order(scores.select("person_id", "label", (-F.col("score")).alias("_down")), "person_id")
    n, n_pos = scores.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    sets = F.array(*[F.lit(str(f)) for f in fractions])
    # half even on the double product, as bround does
    wanted = {str(f): max(1, round(n * f)) for f in fractions}
    flagged = first_k(rows.withColumn("set", F.explode(sets)), "set", wanted, ["_down", person], ["person_id"])
    out = flagged.groupBy("set").agg(
        F.count("*").alias("n_flagged"), F.count_if(F.col("label") == 1).alias("tp"),
        F.count_if(F.col("label") != 1).alias("fp")).select(
        F.col("set").cast("double").alias("fraction"), "n_flagged", "tp", "fp", (F.lit(n_pos) - F.col("tp")).alias("fn"),
        (F.lit(n - n_pos) - F.col("fp")).alias("tn"))
    return _with_predictive_values(out)
