"""Comparison of calling methods at genotype, tier and field level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions import alleles as al
from haplodeck.functions.text import is_null_token, pct, share, to_double, truthy
from haplodeck.operators.rows import latest_per_key, with_once

Pair = tuple[str, str]


def load_latest(log: DataFrame, run_label: str, people: DataFrame | None = None,
                keys: list[str] = ("person_id", "gene"), newest: str = "ts",
                tiebreak: list[str] = ()) -> DataFrame:
    """Latest row per key of one run label, with the people's attributes attached."""
    rows = latest_per_key(log.where(F.col("run_label") == run_label), list(keys), newest, tiebreak)
    return rows if people is None else rows.join(people, "person_id", "left")


def stack_methods(df: DataFrame, methods: dict[str, Pair]) -> DataFrame:
    """One row per method: adds method, call_1, call_2."""
    entries = [
        F.struct(F.lit(m).alias("method"), F.col(a).alias("call_1"), F.col(b).alias("call_2"))
        for m, (a, b) in methods.items()
    ]
    return df.withColumn("_m", F.explode(F.array(*entries))).select(
        *df.columns, "_m.method", "_m.call_1", "_m.call_2"
    )


def _leading_equal(x: str, y: str, d: str) -> Column:
    """How many leading fields agree, out of the first d comparable ones."""
    out = F.when(F.get(x, F.lit(0)) != F.get(y, F.lit(0)), 0)
    for i in range(1, 4):
        out = out.when(F.col(d) == i, i).when(F.get(x, F.lit(i)) != F.get(y, F.lit(i)), i)
    return out.otherwise(4)


def with_cascade(df: DataFrame, call: Pair = ("call_1", "call_2"),
                 truth: Pair = ("truth_1", "truth_2"), cut_new: bool = True,
                 name: str = "casc") -> DataFrame:
    """Field cascade of an unordered genotype against another.

    Adds <name>_t1, _d1, _t2, _d2: for each call allele the number t of leading equal fields and
    the number d of comparable fields (at most 4). Level l is true when l <= t, false when t < d
    and l > t, and not assessable otherwise. The better of the two pairings is kept, the straight
    one on a tie. All four are null when any of the four alleles is uncallable.
    """
    base = df.columns
    fields = {
        "_x1": al.field_list(call[0], cut_new), "_x2": al.field_list(call[1], cut_new),
        "_y1": al.field_list(truth[0], cut_new), "_y2": al.field_list(truth[1], cut_new),
    }
    step = with_once(df, fields)
    step = step.withColumns({
        f"_d{i}{j}": F.least(F.size(f"_x{i}"), F.size(f"_y{j}"), F.lit(4))
        for i in (1, 2) for j in (1, 2)
    })
    step = with_once(step, {
        f"_t{i}{j}": _leading_equal(f"_x{i}", f"_y{j}", f"_d{i}{j}") for i in (1, 2) for j in (1, 2)
    })
    callable_ = (
        F.col("_x1").isNotNull() & F.col("_x2").isNotNull()
        & F.col("_y1").isNotNull() & F.col("_y2").isNotNull()
    )
    straight = F.least("_t11", "_t22") * 5 + F.greatest("_t11", "_t22")
    crossed = F.least("_t12", "_t21") * 5 + F.greatest("_t12", "_t21")
    step = step.withColumns({"_ok": callable_, "_cross": crossed > straight})

    def pick(straight_name: str, crossed_name: str) -> Column:
        return F.when(F.col("_ok"), F.when(F.col("_cross"), F.col(crossed_name)).otherwise(
            F.col(straight_name)))

    return with_once(step, {
        f"{name}_t1": pick("_t11", "_t12"), f"{name}_d1": pick("_d11", "_d12"),
        f"{name}_t2": pick("_t22", "_t21"), f"{name}_d2": pick("_d22", "_d21"),
    }).select(*base, *[f"{name}_{x}" for x in ("t1", "d1", "t2", "d2")])


def level_true(name: str, allele: int, level: int) -> Column:
    return F.col(f"{name}_t{allele}") >= level


def level_false(name: str, allele: int, level: int) -> Column:
    t, d = F.col(f"{name}_t{allele}"), F.col(f"{name}_d{allele}")
    return (t < d) & (t < level)


def genotype_status(name: str, level: int) -> Column:
    """concordant / discordant / na at one level, null when the cascade is null."""
    return (
        F.when(F.col(f"{name}_t1").isNull(), None)
        .when(level_false(name, 1, level) | level_false(name, 2, level), "discordant")
        .when(level_true(name, 1, level) & level_true(name, 2, level), "concordant")
        .otherwise("na")
    )


def cascade_counts(df: DataFrame, keys: list[str], name: str = "casc",
                   levels: list[int] = domain.FIELD_LEVELS) -> DataFrame:
    """Per-allele true / false / na counts per key and level. Levels are laid out as columns of
    one aggregate and turned into rows afterwards, so nothing is multiplied before the shuffle."""
    aggs = [F.count("*").alias("_n")]
    for level in levels:
        aggs += [
            F.sum(level_true(name, 1, level).cast("int") + level_true(name, 2, level).cast("int"))
            .alias(f"_true{level}"),
            F.sum(level_false(name, 1, level).cast("int") + level_false(name, 2, level).cast("int"))
            .alias(f"_false{level}"),
        ]
    wide = df.where(F.col(f"{name}_t1").isNotNull()).groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(level).alias("field_level"),
            F.col(f"_true{level}").alias("n_true"),
            F.col(f"_false{level}").alias("n_false"),
            (F.col("_n") * 2 - F.col(f"_true{level}") - F.col(f"_false{level}")).alias("n_na"),
        )
        for level in levels
    ])
    return wide.withColumn("_r", F.explode(rows)).select(*keys, "_r.*")


def cascade_by_method(df: DataFrame, methods: dict[str, Pair], truth: Pair,
                      genes: list[str] = domain.GENES, groups: list[str] | None = None,
                      keys: list[str] = ("gene", "ancestry"), cut_new: bool = True) -> DataFrame:
    """Cascade counts per key, method and level, inside the given genes and groups."""
    rows = df.where(F.col("gene").isin(genes))
    if groups:
        rows = rows.where(F.col("ancestry").isin(groups))
    stacked = stack_methods(rows, methods)
    return cascade_counts(with_cascade(stacked, truth=truth, cut_new=cut_new), [*keys, "method"])


def with_rates(counts: DataFrame) -> DataFrame:
    """match_pct among assessable alleles and na_pct among all."""
    assessable = F.col("n_true") + F.col("n_false")
    return counts.withColumns({
        "match_pct": pct(F.col("n_true"), assessable),
        "na_pct": pct(F.col("n_na"), assessable + F.col("n_na")),
    })


def pool_counts(counts: DataFrame, keys: list[str] = ("gene", "method", "field_level")) -> DataFrame:
    """Cascade counts summed over everything but `keys`, with rates."""
    return with_rates(counts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_true", "n_false", "n_na")]
    ))


def method_max_depth(df: DataFrame, methods: dict[str, Pair], cut_new: bool = True) -> DataFrame:
    """Deepest call each method ever makes; 0 when it never calls."""
    stacked = stack_methods(df, methods)
    return stacked.groupBy("method").agg(
        F.coalesce(
            F.greatest(F.max(al.depth("call_1", cut_new)), F.max(al.depth("call_2", cut_new))),
            F.lit(0),
        ).cast("int").alias("max_depth")
    )


def mark_structural_cap(pooled: DataFrame, depths: DataFrame) -> DataFrame:
    """Flags levels that lie beyond anything the method reports anywhere."""
    return pooled.join(depths, "method").withColumn(
        "structural_cap", F.col("field_level") > F.col("max_depth")
    )


def field_matrix(counts: DataFrame, level: int = 2, groups: list[str] = domain.GROUPS) -> DataFrame:
    """Gene x group match rate of one level, one column per group, one row per gene and method."""
    at_level = with_rates(counts.where(F.col("field_level") == level))
    return at_level.groupBy("gene", "method").pivot("ancestry", groups).agg(F.first("match_pct"))


def threeway_concordance(df: DataFrame, a: Pair, b: Pair, c: Pair, identity: Pair, tied: Pair,
                         keys: list[str] = ("gene", "ancestry"),
                         min_identity: float = domain.CONFIDENT_IDENTITY) -> DataFrame:
    """Pairwise and three-way agreement of methods a, b, c on unordered two-field genotypes.

    Among rows where all three call: a_b, a_c, b_c agreements, agree3, a_lone (b equals c, a
    differs), c_diverges (a equals b, c differs) and c_diverges_confident (c neither tied nor
    below the identity bar on either haplotype)."""
    def pair(p: Pair) -> Column:
        return al.unordered_pair(al.two_field(p[0]), al.two_field(p[1]))

    step = with_once(df, {"_a": pair(a), "_b": pair(b), "_c": pair(c)})
    id1, id2 = to_double(identity[0]), to_double(identity[1])
    confident = (
        ~truthy(tied[0]) & ~truthy(tied[1])
        & F.coalesce(id1 >= min_identity, F.lit(False))
        & F.coalesce(id2 >= min_identity, F.lit(False))
    )
    ab, ac, bc = F.col("_a") == F.col("_b"), F.col("_a") == F.col("_c"), F.col("_b") == F.col("_c")
    called = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_c").isNotNull()
    return step.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(called).alias("callable_n"),
        F.count_if(called & ab & ac).alias("agree3"),
        F.count_if(called & ab).alias("a_b"),
        F.count_if(called & ac).alias("a_c"),
        F.count_if(called & bc).alias("b_c"),
        F.count_if(called & bc & ~ab).alias("a_lone"),
        F.count_if(called & ab & ~bc).alias("c_diverges"),
        F.count_if(called & ab & ~bc & confident).alias("c_diverges_confident"),
    )


def agreement_tier(c1: Column, c2: Column, t1: Column, t2: Column) -> Column:
    """EXACT / CLOSE / PARTIAL_MISS / FULL_MISS of two-field keys under the better pairing
    (more exact alleles, then more of the same group, the straight pairing on a tie)."""
    def hit(a: Column, b: Column) -> Column:
        return (a == b).cast("int")

    def kin(a: Column, b: Column) -> Column:
        return (al.allele_group(a) == al.allele_group(b)).cast("int")

    exact_s, exact_x = hit(c1, t1) + hit(c2, t2), hit(c1, t2) + hit(c2, t1)
    kin_s, kin_x = kin(c1, t1) + kin(c2, t2), kin(c1, t2) + kin(c2, t1)
    best = F.greatest(exact_s * 3 + kin_s, exact_x * 3 + kin_x)
    exact, family = F.floor(best / 3), best % 3
    return (
        F.when(best.isNull(), None).when(exact == 2, "EXACT").when(family == 2, "CLOSE")
        .when(family == 1, "PARTIAL_MISS").otherwise("FULL_MISS")
    )


def resolution_tiers(df: DataFrame, methods: dict[str, Pair], truth: Pair) -> DataFrame:
    """Tier counts per gene and method plus an ALL row, among rows where every method and the
    truth have a two-field genotype."""
    names = {f"_k{i}": c for i, c in enumerate([*truth, *[x for p in methods.values() for x in p]])}
    step = with_once(df, {k: al.two_field(c) for k, c in names.items()}).select(
        "gene", *names).dropna(subset=list(names))
    cols = list(names)
    pairs = {m: (cols[2 + 2 * i], cols[3 + 2 * i]) for i, m in enumerate(methods)}
    stacked = stack_methods(step, pairs).withColumn(
        "tier", agreement_tier(F.col("call_1"), F.col("call_2"), F.col(cols[0]), F.col(cols[1]))
    )
    tiers = ["EXACT", "CLOSE", "PARTIAL_MISS", "FULL_MISS"]
    counts = stacked.groupBy("gene", "method").agg(
        F.count("*").alias("callable_n"),
        *[F.count_if(F.col("tier") == t).alias(f"n_{t.lower()}") for t in tiers],
    )
    return with_total(counts, ["method"], "gene", ["callable_n", *[f"n_{t.lower()}" for t in tiers]])


def with_total(counts: DataFrame, keys: list[str], over: str, sums: list[str],
               label: str = "ALL") -> DataFrame:
    """Adds one row per `keys` that sums over `over`. Works on the small aggregate, so the source
    is read once."""
    rolled = counts.groupingSets([[*[F.col(k) for k in keys], F.col(over)],
                                  [F.col(k) for k in keys]], *keys, over)
    out = rolled.agg(F.grouping(over).alias("_all"), *[F.sum(s).alias(s) for s in sums])
    named = F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(over))
    return out.withColumn(over, named).select(*keys, over, *sums)


def status_rollup(df: DataFrame, a: Pair, b: Pair,
                  levels: list[int] = domain.FIELD_LEVELS) -> DataFrame:
    """Genotype status counts per gene x group x level, with an ALL group per gene."""
    step = with_cascade(df, a, b)
    aggs = []
    for level in levels:
        status = genotype_status("casc", level)
        aggs += [F.count_if(status == "concordant").alias(f"_c{level}"),
                 F.count_if(status == "discordant").alias(f"_d{level}")]
    wide = step.where(F.col("casc_t1").isNotNull()).groupBy("gene", "ancestry").agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(level).alias("field_level"), F.col(f"_c{level}").alias("concordant"),
                 F.col(f"_d{level}").alias("discordant"))
        for level in levels
    ])
    long = wide.withColumn("_r", F.explode(rows)).select("gene", "ancestry", "_r.*")
    total = with_total(long, ["gene", "field_level"], "ancestry", ["concordant", "discordant"])
    assessable = F.col("concordant") + F.col("discordant")
    return total.withColumns(
        {"assessable": assessable, "concordant_pct": pct(F.col("concordant"), assessable)}
    )


def pair_reason(a: Pair, b: Pair, a_name: str, b_name: str) -> Column:
    """Why a slot can or cannot be compared."""
    a1, a2, b1, b2 = (is_null_token(c) for c in (*a, *b))
    a_none, b_none = a1 & a2, b1 & b2
    return (
        F.when(a_none & b_none, "both_na")
        .when(a_none, f"{a_name}_na_{b_name}_resolved")
        .when(b_none, f"{b_name}_na_{a_name}_resolved")
        .when((a1 != a2) | (b1 != b2), "one_haplotype_na")
        .otherwise("both_resolved")
    )


def unresolved_reasons(slots: DataFrame, a: Pair, b: Pair, a_name: str, b_name: str) -> DataFrame:
    """Reason counts per gene, with an ALL row."""
    counts = slots.groupBy("gene", pair_reason(a, b, a_name, b_name).alias("reason")).agg(
        F.count("*").alias("n")
    )
    return with_total(counts, ["reason"], "gene", ["n"])


def person_gene_slots(people: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    """Every (person, gene) that could be called: the shared denominator."""
    return people.withColumn("gene", F.explode(F.array(*[F.lit(g) for g in genes])))


def concordance_detail(slots: DataFrame, a: Pair, b: Pair, a_name: str, b_name: str,
                       label: Column, has_b: Column, level: int = 2) -> DataFrame:
    """One row per slot: calls, confidence label, reason and status at one level. Carries person
    ids, so it is for local diagnosis only."""
    step = with_once(with_cascade(slots, a, b), {"reason": pair_reason(a, b, a_name, b_name)})
    status = (
        F.when(F.col("reason") != "both_resolved", "-")
        .when(F.col("casc_t1").isNull(), "unresolved(allele-level)")
        .otherwise(genotype_status("casc", level))
    )
    return step.select(
        "person_id", "ancestry", "gene",
        *[F.coalesce(F.col(c), F.lit("NA")).alias(c) for c in (*a, *b)],
        F.when(has_b, label).otherwise(f"no_{b_name}_row").alias("confidence"),
        "reason", status.alias(f"field{level}_status"),
    )


def na_slots(calls: DataFrame, pair: Pair, genes: list[str] = domain.GENES) -> DataFrame:
    """Uncalled haplotype slots per gene among people with any call; a person without a row for
    the gene counts as two."""
    people = calls.select("person_id").distinct()
    grid = person_gene_slots(people, genes)
    missing = sum(
        al.clean_fields(c).isNull().cast("int") for c in pair
    )
    joined = grid.join(calls, ["person_id", "gene"], "left")
    return joined.groupBy("gene").agg(
        F.sum(missing).alias("na_slots"), (F.count("*") * 2).alias("total_slots")
    ).withColumn("na_pct", pct(F.col("na_slots"), F.col("total_slots")))


def call_matrix(base: DataFrame, sr: DataFrame, lr_haplotypes: DataFrame,
                people: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    """Callers side by side per (person, gene), the long-read haplotypes turned into columns.
    Missing callers read NA."""
    evidence = ["call", "identity", "reads", "ambig_n", "tied", "step1"]
    lr = lr_haplotypes.groupBy("person_id", "gene").agg(*[
        F.max(F.when(F.col("hap") == h, F.col(e))).alias(f"lr_{e}_{h}")
        for e in evidence for h in (1, 2)
    ])
    out = (
        person_gene_slots(people, genes)
        .join(base, ["person_id", "gene"], "left")
        .join(sr, ["person_id", "gene"], "left")
        .join(lr, ["person_id", "gene"], "left")
    )
    calls = ["base_1", "base_2", "sr_1", "sr_2", "lr_call_1", "lr_call_2"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("NA")) for c in calls})


def config_comparison(log: DataFrame, baseline: str, pair: Pair, newest: str = "ts",
                      tiebreak: list[str] = ()) -> DataFrame:
    """Every run label against the baseline label: genotypes compared and identical at two fields."""
    return compared_configs(latest_per_key(log, ["person_id", "gene", "run_label"], newest, tiebreak), baseline, pair)


def compared_configs(rows: DataFrame, baseline: str, pair: Pair) -> DataFrame:
    """As `config_comparison`, on one row per (person, gene, label). The baseline's genotype comes from a
    window over a slot's labels, so the rows are made once and stay where they are."""
    keyed = with_once(rows.select("person_id", "gene", "run_label", *pair), {
        "key": al.unordered_pair(al.two_field(pair[0]), al.two_field(pair[1]))})
    slot = Window.partitionBy("person_id", "gene")
    is_base = F.col("run_label") == baseline
    based = keyed.select("person_id", "gene", "run_label", "key").withColumns({
        "base_key": F.max(F.when(is_base, F.col("key"))).over(slot), "_has": F.count_if(is_base).over(slot)})
    return based.where(~is_base & (F.col("_has") > 0)).groupBy("run_label", "gene").agg(
        F.count("*").alias("n_slots"),
        F.count_if(F.col("key").isNotNull() & F.col("base_key").isNotNull()).alias("n_compared"),
        F.count_if(F.col("key") == F.col("base_key")).alias("n_same"),
    ).withColumn("same_share", share(F.col("n_same"), F.col("n_compared")))


def attach_truth(rows: DataFrame, truth: DataFrame, keys: list[str] = ("person_id", "gene")) -> DataFrame:
    """Left lookup of another method's calls; has_truth says whether a row was there at all."""
    return rows.join(truth.withColumn("_hit", F.lit(True)), list(keys), "left").withColumn(
        "has_truth", F.col("_hit").isNotNull()
    ).drop("_hit")


def lookup_misses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gene").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("has_truth")).alias("n_without_truth")
    )
