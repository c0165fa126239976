"""Alignment text: PAF blocks and insert-size histogram lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck.sources.callers import PERSON_PATTERN, path_part

_PAF = ["qname string", "qlen long", "qstart long", "qend long", "strand string", "tname string",
        "tlen long", "tstart long", "tend long", "matches long", "block_len long", "mapq int"]


def parse_paf(lines: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Tab lines with at least twelve columns as typed blocks."""
    parts = F.split("value", "\t")
    cols = [F.get(parts, F.lit(i)).try_cast(t.split()[1]).alias(t.split()[0])
            for i, t in enumerate(_PAF)]
    return lines.where(F.size(parts) >= 12).select(*keep, *cols)


def read_paf(spark: SparkSession, glob: str, person: str = PERSON_PATTERN) -> DataFrame:
    """Plain or gzipped files; the codec follows the file name."""
    return parse_paf(spark.read.text(glob).select(path_part(person).alias("person_id"), "value"),
                     ["person_id"])


def parse_insert_sizes(lines: DataFrame) -> DataFrame:
    """IS lines of alignment statistics -> size, pairs."""
    parts = F.split("value", "\t")
    return lines.where(F.startswith("value", F.lit("IS\t"))).select(
        F.get(parts, F.lit(1)).cast("int").alias("size"),
        F.get(parts, F.lit(2)).cast("long").alias("pairs"))


def read_insert_sizes(spark: SparkSession, glob: str) -> DataFrame:
    return parse_insert_sizes(spark.read.text(glob))
