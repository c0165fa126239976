"""Caller output files, read for all samples at once; the person comes from the file path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions import alleles as al
from haplodeck.functions import callinfo
from haplodeck.functions.text import minutes_from_real_text
from haplodeck.operators.rows import first_per_key, with_once

PERSON_PATTERN = r"/([^/]+)/[^/]+$"  # parent folder of the file


def path_part(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_wide_results(spark: SparkSession, glob: str, genes: list[str] = domain.GENES,
                      names: tuple[str, str] = ("sr_1", "sr_2")) -> DataFrame:
    """One-row-per-sample results HLA_<gene>_1/2 -> person_id, gene and the two calls. Comment
    lines are skipped; an absent column reads NA."""
    df = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(glob)
    have = set(df.columns)

    def cell(gene: str, hap: int) -> Column:
        name = f"HLA_{gene}_{hap}"
        return F.col(name) if name in have else F.lit("NA")

    entries = [F.struct(F.lit(g).alias("gene"), cell(g, 1).alias(names[0]),
                        cell(g, 2).alias(names[1])) for g in genes]
    return df.select(F.col(df.columns[0]).alias("person_id"),
                     F.explode(F.array(*entries)).alias("_e")).select("person_id", "_e.*")


def parse_haplotypes(rows: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    """Per-haplotype caller rows -> person_id, gene, hap 1/2 by chromosome order, call and its
    evidence. A locus with fewer than two rows is dropped; only its first two rows are ever moved,
    so the count that decides this never looks at more than two."""
    rows = rows.where(F.col("Locus").isin([f"HLA-{g}" for g in genes])).withColumns({
        "gene": al.bare_gene("Locus"),
        "call": callinfo.chosen_call("One_guess", "Genotype"),
    })
    keys = ["person_id", "gene"]
    pair = first_per_key(rows, keys, [F.col("Chromosome"), F.col("call")], 2, "hap")
    counted = pair.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    kept = with_once(counted.where(F.col("_n") == 2),
                     {"_entries": callinfo.match_entries("Match_info")})
    return kept.select(
        "person_id", "gene", "hap", "call",
        callinfo.match_identity("_entries", "call").alias("identity"),
        F.col("Reads_num").try_cast("int").alias("reads"),
        callinfo.ambiguity_count("Genotype").alias("ambig_n"),
        callinfo.match_tied("_entries").alias("tied"),
        F.coalesce("Step1_type", F.lit("NA")).alias("step1"),
    )


def read_haplotype_results(spark: SparkSession, glob: str, person: str = PERSON_PATTERN,
                           genes: list[str] = domain.GENES) -> DataFrame:
    df = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(glob)
    return parse_haplotypes(df.withColumn("person_id", path_part(person)), genes)


def read_minutes(spark: SparkSession, glob: str, person: str = PERSON_PATTERN) -> DataFrame:
    """Minutes per person out of shell timing files; files without a timing line are left out."""
    df = spark.read.option("wholetext", True).text(glob)
    return df.select(path_part(person).alias("person_id"),
                     minutes_from_real_text("value").alias("minutes")).where("minutes is not null")
