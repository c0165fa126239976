"""File URIs as text: bucket stripping and kind by file-name ending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions.text import col


def relative_path(uri: Column | str, bucket: str, rejected: str | None = None,
                  scheme: str = "gs://") -> Column:
    """Path inside `bucket`; null for blanks, for the `rejected` bucket name and for other buckets."""
    u = col(uri)
    bad = u.isNull() | (u == "")
    if rejected:
        bad = bad | F.contains(u, F.lit(rejected))
    return (
        F.when(bad, None)
        .when(F.startswith(u, F.lit(bucket)), F.substr(u, F.lit(len(bucket) + 1)))
        .when(F.startswith(u, F.lit(scheme)), None)
        .otherwise(u)
    )


def _ends_with_any(c: Column, endings: list[str]) -> Column:
    hit = F.lit(False)
    for ending in endings:
        hit = hit | F.endswith(c, F.lit(ending))
    return hit


def file_kind(uri: Column | str, primary: list[str] = domain.PRIMARY_EXTENSIONS,
              index: list[str] = domain.INDEX_EXTENSIONS) -> Column:
    """'primary' for data files, 'index' for companions, null for anything not path-like."""
    u = col(uri)
    pathlike = F.startswith(u, F.lit("gs://")) | F.contains(u, F.lit("/"))
    low = F.lower(u)
    return F.when(pathlike & _ends_with_any(low, primary), "primary").when(
        pathlike & _ends_with_any(low, index), "index"
    )


def region_parts(region: Column | str) -> Column:
    """'chr6:1-9' -> struct(contig, start, end)."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    return F.struct(
        F.regexp_extract(col(region), pattern, 1).alias("contig"),
        F.regexp_extract(col(region), pattern, 2).try_cast("long").alias("start"),
        F.regexp_extract(col(region), pattern, 3).try_cast("long").alias("end"),
    )


def region_text(contig: Column | str, start: Column | str, end: Column | str,
                zero_based: bool = True) -> Column:
    first = col(start) + (1 if zero_based else 0)
    return F.concat(col(contig), F.lit(":"), first.cast("string"), F.lit("-"), col(end).cast("string"))
