"""Result tables: guarded writes, appends, keyed upserts and small report text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from haplodeck.operators.rows import upsert


def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False,
                partition_by: list[str] = (), **options) -> None:
    """Refuses to replace an existing result unless told to."""
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists")
    if fmt == "csv":
        options = {"header": True, "sep": "\t", **options}
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**options).save(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to the master log, one folder per run label, so a label filter reads only its own
    folder."""
    rows.write.mode("append").partitionBy("run_label").parquet(path)


def upsert_table(new: DataFrame, current: str, target: str, keys: list[str]) -> None:
    """Writes the current table with the new rows' keys replaced to another path; the caller swaps
    the paths, so a failed job leaves the old table whole."""
    old = new.sparkSession.read.parquet(current)
    upsert(old, new, keys).write.mode("errorifexists").parquet(target)


def markdown_table(df: DataFrame) -> Iterator[str]:
    """Lines of a report table, all rows, one partition at a time on the driver."""
    yield "| " + " | ".join(df.columns) + " |"
    yield "|" + "---|" * len(df.columns)
    for row in df.toLocalIterator():
        cells = ["" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in row]
        yield "| " + " | ".join(cells) + " |"
