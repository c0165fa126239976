"""Cross-validated L1 risk model on sparse allele dosages, fitted by Spark's own trainer."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions import alleles as al
from haplodeck.operators.prefix import global_rank
from haplodeck.operators.rows import with_once
from haplodeck.session import cut_lineage

#: Bound on the trainer's steps; it stops earlier once converged, and the results say so.
MAX_ITER = 2000


class TooFewCases(ValueError):
    """Raised instead of fitting when there is not enough signal."""


def _tokens(k1: str, k2: str):
    """gene*allele of both haplotypes."""
    return F.array(F.concat("gene", F.lit("*"), F.col(k1)), F.concat("gene", F.lit("*"), F.col(k2)))


def _keyed(calls: DataFrame, genes: list[str]) -> DataFrame:
    return with_once(calls.where(F.col("gene").isin(genes)).select("person_id", "gene", "a1", "a2"), {
        "_k1": al.two_field("a1", any_case=True), "_k2": al.two_field("a2", any_case=True),
    }).drop("a1", "a2")


def feature_names(calls: DataFrame, people: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    """feature, index: every gene*allele seen in any callable haplotype plus one dummy per ancestry
    group, numbered in name order. The table stays on the cluster."""
    keyed = _keyed(calls, genes)
    alleles = keyed.select(F.explode(F.array("_k1", "_k2")).alias("_k"), "gene").where(
        F.col("_k").isNotNull()).select(F.concat("gene", F.lit("*"), "_k").alias("feature")).distinct()
    dummies = people.where(F.col("ancestry").isNotNull()).select(
        F.concat(F.lit("ancestry_"), "ancestry").alias("feature")).distinct()
    ranked = global_rank(alleles.unionByName(dummies), [F.col("feature")], "_r")
    return cut_lineage(ranked.select("feature", (F.col("_r") - 1).cast("int").alias("index")))


def feature_tokens(calls: DataFrame, people: DataFrame, genes: list[str] = domain.GENES) -> DataFrame:
    """person_id, ancestry, label, tokens of people callable at every gene and labelled. One
    conditional column per gene keeps the per-person state bounded even if rows come twice."""
    keyed = _keyed(calls, genes).where(F.col("_k1").isNotNull() & F.col("_k2").isNotNull())
    pair = _tokens("_k1", "_k2")
    per = keyed.groupBy("person_id").agg(*[
        F.max(F.when(F.col("gene") == g, pair)).alias(f"_g{i}") for i, g in enumerate(genes)
    ]).dropna(subset=[f"_g{i}" for i in range(len(genes))])
    tokens = F.concat(*[F.col(f"_g{i}") for i in range(len(genes))])
    dummy = F.when(F.col("ancestry").isNotNull(), F.array(F.concat(F.lit("ancestry_"), "ancestry")))
    return per.select("person_id", tokens.alias("_t")).join(
        people.where(F.col("case").isNotNull()).select("person_id", "ancestry", "case"), "person_id"
    ).select(
        "person_id", "ancestry", F.col("case").cast("double").alias("label"),
        F.concat("_t", F.coalesce(dummy, F.array().cast("array<string>"))).alias("tokens"))


def feature_dosages(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """person_id, index, dosage: how often each numbered name occurs in a person's tokens. The names are broadcast:
    they are as many as the coefficients, which the fits hold on the driver, and a join by name would
    send all tokens of a common name to one task."""
    return tokens.select("person_id", F.explode("tokens").alias("feature")).join(
        F.broadcast(names), "feature").groupBy("person_id", "index").agg(F.count("*").cast("double").alias("dosage"))


@F.udf(VectorUDT())
def _sparse(size, pairs):
    return Vectors.sparse(size, [(p["index"], p["dosage"]) for p in pairs])


def feature_matrix(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Sparse dosage vectors: a name that occurs twice in a person's tokens has value 2. Names are
    joined, so the driver only learns how many there are; a person has a few dozen."""
    size = names.count()
    pairs = feature_dosages(tokens, names).groupBy("person_id").agg(
        F.sort_array(F.collect_list(F.struct("index", "dosage"))).alias("_pairs"))
    none = F.array().cast("array<struct<index:int,dosage:double>>")
    return tokens.drop("tokens").join(pairs, "person_id", "left").withColumn(
        "features", _sparse(F.lit(size), F.coalesce("_pairs", none))).drop("_pairs")


def feature_dosage_totals(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """feature, n_people, total, deviation (population deviation of the dosage over all people): what
    the scaler divides by."""
    n = tokens.agg(F.count("*").alias("_n"))
    per = feature_dosages(tokens, names).groupBy("index").agg(
        F.count("*").alias("n_people"), F.sum("dosage").alias("total"),
        F.sum(F.col("dosage") * F.col("dosage")).alias("_squares"))
    mean = F.coalesce(F.col("total"), F.lit(0.0)) / F.col("_n")
    spread = F.coalesce(F.col("_squares"), F.lit(0.0)) / F.col("_n") - mean * mean
    return names.join(per, "index", "left").join(F.broadcast(n)).select(  # one row
        "feature", F.coalesce("n_people", F.lit(0)).alias("n_people"),
        F.coalesce("total", F.lit(0.0)).cast("long").alias("total"),
        F.round(F.sqrt(F.greatest(spread, F.lit(0.0))), 9).alias("deviation"))


def model_population(folded: DataFrame) -> DataFrame:
    """n_people, n_cases, n_folds and the smallest and largest fold by people."""
    per = folded.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("c"))
    return per.agg(
        F.sum("n").alias("n_people"), F.sum("c").cast("long").alias("n_cases"), F.count("*").alias("n_folds"),
        F.min("n").alias("smallest_fold"), F.max("n").alias("largest_fold"))


def stratified_folds(rows: DataFrame, n: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """Adds fold 0..n-1, the same on any partitioning: rows are ordered by (label, hash of the id)
    and dealt out in turn, so every fold has the label mix of the whole to within one row."""
    keys = rows.select("person_id", F.col(label).alias("_l")).withColumn(
        "_h", F.xxhash64("person_id", F.lit(seed)))
    dealt = global_rank(keys, [F.col("_l"), F.col("_h"), F.col("person_id")], "_r").select(
        "person_id", ((F.col("_r") - 1) % n).cast("int").alias("fold"))
    return rows.join(dealt, "person_id")


def fit_l1(train: DataFrame, c: float = 0.1, max_iter: int = MAX_ITER
           ) -> tuple[StandardScalerModel, LogisticRegressionModel]:
    """Scaler and L1 logistic model, both fitted on `train` only. The scaler does not centre; it
    divides by the n-1 deviation, and the penalty carries the factor that makes this the same
    problem as dividing by the n deviation. The penalty per row is 1 / (C n)."""
    n = train.count()
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False,
                            withStd=True).fit(train)
    trainer = LogisticRegression(
        featuresCol="scaled", labelCol="label", elasticNetParam=1.0, standardization=False,
        regParam=math.sqrt((n - 1) / n) / (c * n), maxIter=max_iter)
    return scaler, trainer.fit(scaler.transform(train))


def check_cases(rows: DataFrame, min_cases: int = domain.MIN_GROUP_CASES) -> None:
    counts = rows.agg(F.count_if(F.col("label") == 1).alias("p"),
                      F.count_if(F.col("label") == 0).alias("q")).first()
    if counts["p"] < min_cases or counts["q"] == 0:
        raise TooFewCases(f"{counts['p']} cases, {counts['q']} controls")


def converged(model: LogisticRegressionModel, max_iter: int) -> bool:
    """Whether the trainer stopped by itself."""
    return model.summary.totalIterations < max_iter


def out_of_fold_scores(folded: DataFrame, n: int = 5, c: float = 0.1, max_iter: int = MAX_ITER) -> DataFrame:
    """Every person scored by a model that never saw them: person_id, ancestry, label, fold, score,
    and whether the fold's fit converged.
    The vectors are written to the checkpoint folder once, not rebuilt for each of the fits."""
    check_cases(folded)
    folded = cut_lineage(folded)
    out = None
    for fold in range(n):
        scaler, model = fit_l1(folded.where(F.col("fold") != fold), c, max_iter)
        held = model.transform(scaler.transform(folded.where(F.col("fold") == fold)))
        part = held.select(
            "person_id", "ancestry", F.col("label").cast("int").alias("label"), "fold",
            F.get(vector_to_array("probability"), F.lit(1)).alias("score"),
            F.lit(converged(model, max_iter)).alias("converged"))
        out = part if out is None else out.unionByName(part)
    return out


def coefficients(rows: DataFrame, names: DataFrame, c: float = 0.1, max_iter: int = MAX_ITER) -> DataFrame:
    """One fit on all rows, for reading only: feature, coefficient per scaled copy, odds ratio,
    converged. The trainer keeps its coefficients on the driver; names are joined to their numbers."""
    check_cases(rows)
    _, model = fit_l1(cut_lineage(rows), c, max_iter)
    table = rows.sparkSession.createDataFrame(
        [(i, float(v)) for i, v in enumerate(model.coefficients.toArray())], "index int, coefficient double")
    return names.join(table, "index").select(
        "feature", "coefficient", F.exp("coefficient").alias("odds_ratio"),
        F.lit(converged(model, max_iter)).alias("converged"))


def top_coefficients(table: DataFrame, k: int = 15) -> DataFrame:
    """The k strongest risk and the k strongest protective features."""
    up = table.orderBy(F.col("coefficient").desc(), "feature").limit(k).withColumn(
        "direction", F.lit("risk"))
    down = table.orderBy(F.col("coefficient"), "feature").limit(k).withColumn(
        "direction", F.lit("protective"))
    return up.unionByName(down)


def nonzero_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if(F.col("coefficient") != 0).alias("n_nonzero"),
                     F.count("*").alias("n_features"))
