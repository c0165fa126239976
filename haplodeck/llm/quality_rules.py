"""Risk-controlled quality rules.

Every rule compares one ratio of a text with a cutoff. Cutoffs are certified on labelled documents:
for each stratum and rule the candidates are tested from the most lenient to the strictest, and a
cutoff is certified while the exact binomial bound holds, that is while so few good documents fall
beyond it that a false-rejection rate of RISK / rules or more would show so few with a probability
of at most CONFIDENCE / (rules * strata). Testing in a fixed order spends no error on the number of
candidates; rules and strata are corrected for. So with probability 1 - CONFIDENCE no stratum loses
more than RISK of its good documents to all rules together. Of the certified cutoffs, the most
lenient that still catches nearly all that the strictest catches of the documents labelled bad is
used. A stratum in which a rule has no certified cutoff goes without the rule in `kept_documents`. The
verdicts of the registered query follow their statement: there such a stratum takes the cutoff certified
on all documents, so the bound holds for all documents together but not for that stratum.

Null text has no words. A null stratum is a stratum of its own. Labels of documents that are
labelled both ways are left out. Without labels no rule is certified and only the base verdict
counts. Repeated rows are judged each; other columns are not looked at.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck.llm.tables import written

RISK = 0.05
CONFIDENCE = 0.05
#: A cutoff may miss this share of the bad documents that the strictest certified one catches.
SLACK = 0.01
#: A cutoff is of use if it catches bad documents at this many times the rate it loses good ones.
USEFUL = 5
POOLED = "(all)"

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Rule -> (numerator, denominator, candidate cutoffs from lenient to strict).
RULES = {
    "symbols": ("n_symbols", "n_words", (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "capitals": ("n_capitals", "word_chars", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    "exclamations": ("n_exclamations", "n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1)),
    "repeated_words": ("n_repeat_words", "n_words", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "repeated_lines": ("n_dup_lines", "n_lines", (0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_capitals", "n_exclamations")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Windows are compared by a 64-bit
    hash; they are sorted with their positions only where some window does occur twice."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2),
            lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hashes: Column) -> Column:
        def at(pairs: Column) -> Column:
            marked = F.transform(pairs, lambda p, i: F.when(
                (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]), p["i"]))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        def total(places: Column) -> Column:
            steps = F.transform(places, lambda p, i: F.coalesce(
                F.least(F.get(places, i + 1) - p, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(pairs, lambda p: let(at(p), total)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), covered))


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns and COUNTS of every text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    packed = F.struct(
        let(words, lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
            repeated_words(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
        F.regexp_count(t, F.lit(SYMBOL)).alias("symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("capitals"),
        F.regexp_count(t, F.lit("!")).alias("bangs"))
    fields = dict(zip(COUNTS, ("w.n", "w.chars", "symbols", "l.d", "w.r", "l.n", "capitals", "bangs"),
                      strict=True))
    return docs.select(*keep, F.explode(F.array(packed)).alias("_p")).select(
        *keep, *[F.col(f"_p.{f}").cast("long").alias(c) for c, f in fields.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def few_enough(k: Column, n: Column, rate: Column, error: Column) -> Column:
    """Whether P(Binomial(n, rate) <= k) <= error: the exact upper bound of the rate is below
    `rate`. With k at or above the mean it cannot be, so the sum has few terms."""
    odds = F.log(rate / (1 - rate))
    start = n * F.log1p(-rate)
    state = F.struct(start.alias("log"), F.exp(start).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    small = k < n * rate
    terms = F.when(small & (k > 0), F.sequence(F.lit(1).cast("long"), k)).otherwise(
        F.array().cast("array<bigint>"))
    return small & (F.aggregate(terms, state, step)["sum"] <= error)


def certified_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang",
                      risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum, rule, cutoff, good, bad, lost (good documents beyond it), caught (bad ones): one row
    per stratum and rule with a certified cutoff. `labels` has doc_id and quality (1 good)."""
    one = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max("quality").alias("_q")).where("q = _q").select("doc_id", "q")
    judged = counts.where(~base_failed()).join(one, "doc_id")
    sides = judged.select(
        F.coalesce(F.col(stratum).cast("string"), F.lit("(none)")).alias("stratum"), "q",
        *[_ratio(r).alias(r) for r in RULES])
    beyond = [F.count_if(F.col(r) > c).alias(f"{r}_{i}")
              for r, (_, _, grid) in RULES.items() for i, c in enumerate(grid)]
    per = sides.groupBy("stratum", "q").agg(F.count("*").alias("n"), *beyond)
    sums = [F.sum(c).alias(c) for c in ("n", *[f"{r}_{i}" for r in RULES for i in range(len(RULES[r][2]))])]
    pooled = per.groupBy("q").agg(*sums).select(F.lit(POOLED).alias("stratum"), *per.columns[1:])
    both = per.unionByName(pooled)
    rows = both.select("stratum", "q", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff"),
                 F.col(f"{r}_{i}").alias("beyond"))
        for r, (_, _, grid) in RULES.items() for i, c in enumerate(grid)])).alias("_c")).select(
        "stratum", "q", "n", "_c.*")
    good, bad = F.col("q") == 1, F.col("q") == 0
    table = rows.groupBy("stratum", "rule", "place", "cutoff").agg(
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(good, F.col("beyond"))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(bad, F.col("beyond"))), F.lit(0)).alias("caught"))
    # one row per stratum, rule and candidate from here on: as many as there are languages, times 44
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy("rule", "place")))
    error = F.lit(confidence / len(RULES)) / strata
    passed = few_enough(F.col("lost"), F.col("good"), F.lit(risk / len(RULES)), F.col("error"))
    order = Window.partitionBy("stratum", "rule").orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    held = table.withColumn("error", error).withColumn("passed", passed.cast("int")).withColumn(
        "passed", F.min("passed").over(so_far)).where("passed = 1")
    most = F.max("caught").over(Window.partitionBy("stratum", "rule"))
    enough = held.withColumn("_most", most).where(
        (F.col("caught") > 0) & (F.col("caught") >= (1 - SLACK) * F.col("_most"))
        & (F.col("caught") * F.col("good") >= USEFUL * F.col("lost") * F.col("bad")))
    return enough.withColumn("_first", F.row_number().over(order)).where("_first = 1").select(
        "stratum", "rule", "cutoff", "good", "lost", "bad", "caught")


def _wide(cutoffs: DataFrame, *keys: str) -> DataFrame:
    return cutoffs.groupBy(*keys).agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])


def verdicts(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang", pooled_too: bool = True) -> DataFrame:
    """base_failed, failed_rules (comma-joined) and kept for every row of `counts`. With `pooled_too` a
    stratum without a cutoff of its own takes the one of all documents, which nothing certifies for it."""
    own = _wide(cutoffs.where(F.col("stratum") != POOLED), "stratum")
    shared = F.col("stratum") == POOLED if pooled_too else F.lit(False)
    pooled = _wide(cutoffs.where(shared)).first()  # one row of five numbers
    joined = counts.withColumn(
        "stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("(none)"))).join(own, "stratum", "left")
    failed = [F.when(_ratio(r) > F.coalesce(F.col(f"_cut_{r}"), F.lit(pooled[f"_cut_{r}"]).cast("double")),
                     F.lit(r)) for r in RULES]
    return joined.withColumns({
        "base_failed": base_failed(),
        "failed_rules": F.concat_ws(",", *failed),
    }).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop(
        "stratum", *[f"_cut_{r}" for r in RULES])


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed, failed_rules, kept."""
    counts = written(text_counts(docs, text, ("doc_id", stratum)), "quality-counts")
    cutoffs = written(certified_cutoffs(counts, labels, stratum), "quality-cutoffs")
    return verdicts(counts, cutoffs, stratum)


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """The documents that pass, all columns; a rule rejects only in strata whose own labels certify it.
    Counts are computed beside each document, so nothing but the small cutoff table is joined."""
    columns = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(columns)])
    at = {c: f"d{columns.index(c)}" for c in ("doc_id", stratum, text)}
    counts = text_counts(docs, text, ("doc_id", stratum))
    cutoffs = written(certified_cutoffs(counts, labels, stratum), "quality-cutoffs")
    judged = verdicts(
        text_counts(own, at[text], tuple(own.columns)), cutoffs, at[stratum], pooled_too=False)
    return judged.where("kept").select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(columns)])
