"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck.llm.tables import written


def component_labels(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for every node of `edges` (a, b): label is the smallest node of its component.

    Each round hangs the larger neighbours of every node on the smallest one around it, then does
    the same for the smaller neighbours; the number of rounds grows with the logarithm of the size.
    Minima are combined before they are shuffled; no neighbours are listed."""
    now = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(around, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b")).where("a <> b").distinct()
        now = written(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("label")))
