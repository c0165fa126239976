"""Nested text of the per-haplotype caller output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haplodeck.functions.text import col, is_null_token


def ambiguity_count(genotype: Column | str) -> Column:
    """Number of candidates in a semicolon list; a blank or missing list has none."""
    parts = F.filter(F.split(col(genotype), ";"), lambda x: x != "")
    return F.coalesce(F.size(parts), F.lit(0))


def chosen_call(one_guess: Column | str, genotype: Column | str) -> Column:
    """The caller's single guess, else the first listed candidate."""
    guess = col(one_guess)
    missing = guess.isNull() | guess.isin("NA", "nan")
    first = F.get(F.split(F.coalesce(col(genotype), F.lit("NA")), ";"), F.lit(0))
    return F.when(~missing, guess).otherwise(first)


def match_entries(info: Column | str) -> Column:
    """'allele|score|identity;…' -> array of structs, entries that do not parse left out."""
    parts = F.transform(F.split(col(info), ";"), lambda p: F.split(p, r"\|"))
    whole = F.filter(parts, lambda b: F.size(b) == 3)
    entries = F.transform(
        whole,
        lambda b: F.struct(
            F.get(b, F.lit(0)).alias("allele"),
            F.trim(F.get(b, F.lit(1))).try_cast("double").alias("score"),
            F.trim(F.get(b, F.lit(2))).try_cast("double").alias("identity"),
        ),
    )
    valid = F.filter(entries, lambda e: e["score"].isNotNull() & e["identity"].isNotNull())
    return F.when(~(is_null_token(info)), valid)


def match_identity(entries: Column | str, allele: Column | str) -> Column:
    """Identity of the first entry that names the chosen allele."""
    hits = F.filter(col(entries), lambda e: e["allele"] == col(allele))
    return F.get(hits, F.lit(0))["identity"]


def match_tied(entries: Column | str) -> Column:
    """True when several entries share the best score."""
    best = F.array_max(F.transform(col(entries), lambda e: e["score"]))
    n_best = F.size(F.filter(col(entries), lambda e: e["score"] == best))
    return F.coalesce(n_best > 1, F.lit(False))
