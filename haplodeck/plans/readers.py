"""Queries over the readers: each writes text files out of a view into the shared folder and reads
them back, or parses lines built from a view."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck.functions.text import display_pct, minutes_from_real_text, pct
from haplodeck.operators import association as assoc
from haplodeck.operators import callset as cs
from haplodeck.operators import census as cen
from haplodeck.plans import fixtures as fx
from haplodeck.plans.queries import QUERIES as BASE_QUERIES
from haplodeck.session import checkpoint_dir
from haplodeck.sources import alignments, annotations, callers, tables

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _csv(df: DataFrame, sep: str = "\t") -> str:
    path = _path(df.sparkSession)
    df.write.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _text(df: DataFrame) -> str:
    path = _path(df.sparkSession)
    df.write.text(path)
    return path


def _tabs(*columns) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def _wide(spark, d):
    return cs.genotypes_wide(fx.callset(spark, d)).withColumnRenamed("person_id", "research_id")


@query
def read_genotypes(spark, d):
    return tables.read_genotypes(spark, _csv(_wide(spark, d))).withColumn(
        "person_id", F.col("person_id").cast("long"))


@query
def read_genotypes_reader_rules(spark, d):
    return tables.read_genotypes(spark, _csv(_wide(spark, d)), keep_na=False).withColumn(
        "person_id", F.col("person_id").cast("long"))


@query
def read_ancestry(spark, d):
    people = fx.persons(spark, d).select(
        F.col("person_id").alias("s"), F.col("ancestry").alias("ancestry_pred"),
        F.concat(F.lit("["), (F.col("person_id") % 7).cast("string"), F.lit("; "),
                 (F.col("cust") % 5).cast("string"), F.lit("]")).alias("pca_features"))
    return tables.read_ancestry(spark, _csv(people, ",")).withColumn("person_id", F.col("person_id").cast("long"))


@query
def read_manifest(spark, d):
    rows = fx.manifest(spark, d).orderBy("row_id").withColumnRenamed("person_id", "research_id").drop("row_id")
    return tables.read_manifest(spark, _csv(rows), ["platform", "hap1_fa"]).withColumn(
        "person_id", F.col("person_id").cast("long"))


@query
def read_catalogue(spark, d):
    lines = fx.catalogue(spark, d).select(F.concat(
        "allele_id", F.lit(","), "gene", F.lit("*"), "allele_full").alias("value"))
    head = fx.table(spark, d, "region").select(F.explode(F.array(
        F.lit("# release"), F.lit("AlleleID,Allele"), F.lit("X1,a,b"), F.lit("X2,Q*01:01"), F.lit(" "))).alias("value"))
    return tables.read_catalogue(spark, _text(lines.unionByName(head)))


@query
def read_phenotype(spark, d):
    cases = fx.persons(spark, d).where("person_id % 5 != 0").select(F.col("person_id").alias("research_id"), "case")
    people = fx.persons(spark, d).select("person_id", "ancestry")
    found = tables.read_phenotype(spark, _csv(cases, ","))
    return assoc.attach_phenotype(people, found.withColumn("person_id", F.col("person_id").cast("long")))


@query
def labelled_calls(spark, d):
    calls = fx.callset(spark, d).select("person_id", "gene", "a1", "a2")
    return cs.join_group(calls, fx.ancestry_with_gaps(spark, d)).groupBy("ancestry", "gene").agg(
        F.count("*").alias("n"), F.count("a1").alias("n_a1"))


@query
def read_wide_results(spark, d):
    wide = _wide(spark, d).drop("DPB1_1", "DPB1_2")
    named = wide.select(F.col("research_id").alias("Sample"), *[
        F.coalesce(F.col(c), F.lit("NA")).alias(f"HLA_{c}") for c in wide.columns if c != "research_id"])
    return callers.read_wide_results(spark, _csv(named)).withColumn("person_id", F.col("person_id").cast("long"))


def _annotation_lines(spark, d):
    calls = fx.callset(spark, d).select("person_id", "gene", F.explode(F.array(
        F.struct(F.lit("hap1").alias("hap"), F.col("a1").alias("call")),
        F.struct(F.lit("hap2").alias("hap"), F.col("a2").alias("call")))).alias("_h")).select(
            "person_id", "gene", "_h.*")

    def line(kind: str, *attributes) -> Column:
        return F.concat(F.lit(f"chr6\ts\t{kind}\t1\t2\t.\t+\t.\t"), *attributes)

    ident = F.concat(F.lit('gene_id "id-'), "gene", F.lit('"; '))
    lines = F.array(
        line("gene", ident, F.lit('gene_name "HLA-'), F.col("gene"), F.lit('"; template_warning "NA"')),
        line("transcript", ident, F.lit('consensus "'), F.coalesce("call", F.lit("")),
             F.lit('"; template_distance '), (F.col("person_id") % 5).cast("string"), F.lit(";")),
        F.lit("# a comment"))
    return calls.select("person_id", "hap", F.posexplode(lines).alias("line_no", "value"))


@query
def annotation_attributes(spark, d):
    return annotations.gene_attributes(
        annotations.parse_lines(_annotation_lines(spark, d)), ["template_distance", "template_warning"])


@query
def annotation_calls(spark, d):
    return annotations.assembly_table(annotations.gene_calls(annotations.parse_lines(_annotation_lines(spark, d))))


@query
def annotation_complete(spark, d):
    return annotations.completed_people(_annotation_lines(spark, d))


@query
def parse_paf(spark, d):
    lines = fx.paf(spark, d).select(_tabs(
        "qname", "qlen", "qstart", "qend", "strand", "tname", F.lit("170805979"), "tstart", "tend", "matches",
        "block_len", F.lit("60"), F.lit("tp:A:P")).alias("value"))
    return alignments.parse_paf(lines).groupBy("tname", "strand").agg(
        F.count("*").alias("n"), F.sum("matches").alias("matches"), F.sum(F.col("tend") - F.col("tstart")).alias("span"),
        F.sum(F.col("qend") - F.col("qstart")).alias("q_span"), F.max("mapq").cast("long").alias("mapq"))


@query
def parse_insert_sizes(spark, d):
    lines = fx.insert_sizes(spark, d).select(F.explode(F.array(
        _tabs(F.lit("IS"), "size", "pairs"), _tabs(F.lit("ISX"), "size"))).alias("value"))
    return alignments.read_insert_sizes(spark, _text(lines)).groupBy("size").agg(F.sum("pairs").alias("pairs"))


@query
def shell_minutes(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", F.concat(
        F.lit("user\t0m1.0s\nreal\t"), (F.col("o_orderkey") % 50).cast("string"), F.lit("m"),
        ((F.col("o_orderkey") % 600) / 10).cast("decimal(5,1)").cast("string"), F.lit("s\nsys\t0m0.1s\n")).alias("value"))
    return orders.select("o_orderkey", F.round(minutes_from_real_text("value"), 6).alias("minutes"))


@query
def worklist(spark, d):
    return cen.load_worklist(BASE_QUERIES["best_tier"](spark, d).join(fx.ancestry_with_gaps(spark, d), "person_id", "left"))


@query
def displayed_missingness(spark, d):
    return fx.callset(spark, d).groupBy("gene").agg(display_pct(
        pct(F.count_if(F.col("a1").isNull()), F.count("*")), 1).alias("missing_pct"))
