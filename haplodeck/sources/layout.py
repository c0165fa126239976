"""Stored layouts: tables bucketed for joins without a shuffle, and tables that change bucket by bucket.

`store_bucketed` writes a table in hash buckets sorted by their keys, so joins, groupings and row choices on
these keys find their rows in place. Tables to be joined need the same keys and number of buckets.

`BucketTable` is for keyed rows that are replaced a few at a time. Its data lies in one folder per commit and
bucket; the manifest says which commit holds the present version of a bucket. A change reads and writes the
buckets of its keys only, and takes effect with the manifest of its commit, which is written last: a failed
change leaves the table as it was, and of two at the same time one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck.operators.rows import latest_per_key, upsert


def store_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, name: str | None = None) -> str:
    """Writes `df` to `path` as an external table in `buckets` hash buckets and returns the table's name.
    The rows are shuffled once, by the same hash, so a bucket is one file."""
    name = name or f"stored_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option(
        "path", path).mode("errorifexists").saveAsTable(name)
    return name


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int,
                  name: str | None = None) -> str:
    """Registers a table that an earlier session stored; returns its name."""
    name = name or f"stored_{uuid.uuid4().hex}"
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


class BucketTable:
    """A keyed table at `path` in `buckets` hash buckets of `keys`."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def create(self, rows: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None, parts: int = 1) -> None:
        """First version of every bucket. With `derive`, narrow `rows` are spread by bucket and key over `parts`
        tasks, and the table's rows are made of them there; it keeps the keys and `_bucket`."""
        rows = rows.withColumn("_bucket", self._bucket())
        if derive:
            self._commit(derive(rows.repartitionByRange(parts, "_bucket", *self.keys)), 0, list(range(self.buckets)), True)
        else:
            self._commit(rows, 0, list(range(self.buckets)))

    def manifest(self) -> DataFrame:
        """bucket, commit, folder of the present version of every bucket."""
        every = self.spark.read.schema("bucket int, folder string, commit int").parquet(f"{self.path}/manifest")
        return every.groupBy("bucket").agg(F.max(F.struct("commit", "folder")).alias("m")).select(
            "bucket", "m.commit", "m.folder")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """Present rows, of some buckets only if given. The paths are listed: one per bucket."""
        now = self.manifest()
        return self._rows(now if only is None else now.where(F.col("bucket").isin(only)))

    def _rows(self, manifest: DataFrame) -> DataFrame:
        parts = [f"{self.path}/data/{r['folder']}/_bucket={r['bucket']}" for r in manifest.collect()]
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def _commit(self, rows: DataFrame, commit: int, touched: list[int], spread: bool = False) -> None:
        folder = f"commit-{commit}-{uuid.uuid4().hex}"
        # a bucket with one heavy key is split over tasks by adaptive execution
        (rows if spread else rows.hint("rebalance", "_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        if commit == 0:
            rows.drop("_bucket").limit(0).write.mode("errorifexists").parquet(f"{self.path}/schema")
        held = {r["_bucket"] for r in self.spark.read.parquet(f"{self.path}/data/{folder}").select(
            "_bucket").distinct().collect()} if self._has_files(folder) else set()
        empty = [b for b in touched if b not in held]
        for b in empty:  # a bucket that lost all its rows, or never had any, is an empty file
            rows.drop("_bucket").limit(0).write.parquet(f"{self.path}/data/{folder}/_bucket={b}")
        self.spark.createDataFrame([(b, folder) for b in touched], "bucket int, folder string").coalesce(1).write.mode(
            "errorifexists").parquet(f"{self.path}/manifest/commit={commit}")

    def _has_files(self, folder: str) -> bool:
        files = self._fs(f"{self.path}/data/{folder}").listStatus(self._hadoop_path(f"{self.path}/data/{folder}"))
        return any(f.isDirectory() for f in files)

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop_path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _change(self, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        new = new.withColumn("_bucket", self._bucket())
        touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # at most one per bucket
        if not touched:
            return []
        now = self.manifest()
        commit = now.agg(F.max("commit")).first()[0] + 1
        old = self._rows(now.where(F.col("bucket").isin(touched)))
        self._commit(merged(old, new.drop("_bucket")).withColumn("_bucket", self._bucket()), commit, touched)
        return touched

    def upsert(self, new: DataFrame) -> list[int]:
        """Rows of keys that come again go, all new rows come; returns the buckets that were rewritten."""
        return self._change(new, lambda old, fresh: upsert(old, fresh, self.keys))

    def compact(self, fragments: DataFrame, row_keys: list[str], version: str) -> list[int]:
        """Last version of every row key among the stored rows and the fragments."""
        def merged(old: DataFrame, fresh: DataFrame) -> DataFrame:
            rows = old.unionByName(fresh, allowMissingColumns=True)
            others = [c for c in rows.columns if c not in row_keys and c != version]
            return latest_per_key(rows, row_keys, version, others)

        return self._change(fragments, merged)

    def vacuum(self) -> int:
        """Deletes versions of buckets that the manifest no longer names; returns how many."""
        keep = {(r["folder"], r["bucket"]) for r in self.manifest().collect()}  # one per bucket
        gone, root = 0, f"{self.path}/data"
        fs = self._fs(root)
        for folder in fs.listStatus(self._hadoop_path(root)):
            for part in fs.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if part.isDirectory() and (folder.getPath().getName(), int(name.split("=")[1])) not in keep:
                    fs.delete(part.getPath(), True)
                    gone += 1
        return gone
