"""Comparison logs and heartbeat logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck.streaming.heartbeats import BEAT_SCHEMA

LOG_COLUMNS = [
    "timestamp", "person_id", "run_label", "gene", "base_1", "base_2", "sr_1", "sr_2", "lr_1",
    "lr_2", "lr_identity_1", "lr_identity_2", "lr_reads_1", "lr_reads_2", "lr_ambig_n_1",
    "lr_ambig_n_2", "lr_tied_1", "lr_tied_2", "lr_step1_1", "lr_step1_2",
]


def read_comparison_logs(spark: SparkSession, glob: str, names: list[str] = LOG_COLUMNS) -> DataFrame:
    """All per-person logs of a tree as one table. Columns are taken by position, so logs whose
    headers use other caller names read the same way; `ts` is the timestamp."""
    df = spark.read.option("header", True).csv(glob)
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {df.columns}")
    return df.toDF(*names).withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def read_heartbeats(spark: SparkSession, glob: str) -> DataFrame:
    """Reload of the JSON-lines heartbeat log; `sec` is the beat's second since 1970."""
    return spark.read.schema(BEAT_SCHEMA).json(glob).withColumn("sec", F.unix_seconds("ts"))
