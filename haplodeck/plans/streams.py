"""Queries that run the streaming jobs themselves on derived beats and read back what they wrote.

Beats arrive in waves: a folder gets the files of a wave, the stream is started, handles what is new and
stops; its checkpoint carries it to the next wave, as a restart would."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck.operators import telemetry as te
from haplodeck.plans import fixtures as fx
from haplodeck.session import checkpoint_dir, cut_lineage
from haplodeck.streaming import heartbeats as hb
from haplodeck.streaming import ingest as ig

STALE_MINUTES, LATE, HOURLY_USD = 120, "2 hours", 1.3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(*[
            F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])

    QUERIES[fn.__name__] = run
    return fn


def stream_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@contextmanager
def state_partitions(spark: SparkSession, most: int = 16) -> Iterator[None]:
    """A stream keeps the number of state partitions it starts with; these jobs hold a row per run."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _beats(spark: SparkSession, d: str) -> DataFrame:
    """Derived beats in the stream's columns, with the sender's own flags."""
    e = F.col("event_id")
    return te.cumulative_beats(fx.beats(spark, d)).select(
        "run_id", "event_id", F.timestamp_seconds("sec").alias("ts"), "run_state",
        F.lit(None).cast("string").alias("phase"), (F.col("run_id") * 1000).alias("people_total"),
        "people_done", "people_failed", "disk_used_pct", "mem_avail_pct",
        ((e % 173 == 0) | (e % 179 == 0)).alias("anomaly"),
        F.when(e % 173 == 0, "queue stuck").alias("anomaly_reason"), "sec")


@query
def alert_messages(spark, d):
    """Alerts with reasons and counters; after the last beat only ticks come, the second one too late to
    tell anything new."""
    folder = stream_folder(spark)
    beats = cut_lineage(_beats(spark, d))
    beats.drop("sec").write.parquet(f"{folder}/in")
    for hours in (None, 4, 30):
        beats.agg((F.max("sec") + 3600 * hours if hours else F.min("sec")).alias("tick_sec")).write.mode(
            "append").parquet(f"{folder}/ticks")
        ticks = spark.readStream.schema("tick_sec long").parquet(f"{folder}/ticks")
        with state_partitions(spark):
            hb.run_alerts(hb.read_beats(spark, f"{folder}/in", fmt="parquet"), f"{folder}/out", STALE_MINUTES,
                          ticks=ticks).awaitTermination()
    found = hb.read_alerts(spark, f"{folder}/out", details=True)
    return found.withColumn("reason", F.regexp_replace("reason", "=[0-9.]+%", "=#%"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """event_id and the text line of every beat, broken ones among them."""
    e = F.col("event_id")
    rows = _beats(spark, d).withColumn("received_sec", F.col("sec") + e % 5)
    odd = rows.withColumns({
        "run_id": F.when(e % 59 != 0, F.col("run_id")), "ts": F.when(e % 61 != 0, F.col("ts")),
        "people_failed": F.when(e % 67 == 0, -1).otherwise(F.col("people_failed"))})
    payload = [c.split()[0] for c in hb.BEAT_SCHEMA.split(", ")]
    text = F.to_json(F.struct(F.col("received_sec").cast("double").alias("received_ts"), F.struct(*payload).alias("payload")))
    return odd.select(e, F.when(e % 73 == 0, " ").when(e % 53 == 0, F.substring(text, 1, 60))
                      .when(e % 71 == 0, '{"received_ts": 1.0}').otherwise(text).alias("value"))


def _ingested(spark: SparkSession, d: str) -> str:
    """Folder of an ingest in two waves; every 41st line is sent again in the second."""
    folder = stream_folder(spark)
    lines = cut_lineage(_lines(spark, d))
    again: Column = F.col("event_id") % 41 == 0
    for part in (lines.where("event_id % 2 = 0"),
                 lines.where("event_id % 2 = 1").unionByName(lines.where(again))):
        part.select("value").write.mode("append").text(f"{folder}/in")
        with state_partitions(spark):
            ig.ingest(ig.read_lines(spark, f"{folder}/in"), folder).awaitTermination()
    return folder


@query
def beat_ingest(spark, d):
    """Stored beats per run, replayed and blank lines, quarantined lines per reason."""
    folder = _ingested(spark, d)
    stored = ig.read_stored(spark, folder).groupBy("run_id").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("event_sum")).select(
        F.lit("stored").alias("kind"), "run_id", "n", "event_sum")
    none = F.lit(None).cast("long")
    broken = ig.read_quarantine(spark, folder).groupBy("reason").agg(F.count("*").alias("n")).select(
        F.col("reason").alias("kind"), none.alias("run_id"), "n", none.alias("event_sum"))
    told = ig.read_ledger(spark, folder).agg(F.sum("n_blank").alias("blank"), F.sum("n_replayed").alias("replayed"))
    counted = told.unpivot([], ["blank", "replayed"], "kind", "n").select(
        "kind", none.alias("run_id"), "n", none.alias("event_sum"))
    return stored.unionByName(broken).unionByName(counted)


@query
def history_reload(spark, d):
    """What a restarted receiver recovers from the stored beats."""
    return ig.recovered_state(ig.read_stored(spark, _ingested(spark, d)), 500)


def _in_waves(spark: SparkSession, d: str, results: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of an event-time stream over four waves of ten days each, every 37th beat one wave late;
    n_late counts the beats that were dropped."""
    folder, n_late = stream_folder(spark), 0
    wave = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) + (F.col("event_id") % 37 == 0).cast("int")
    beats = cut_lineage(_beats(spark, d).drop("sec").withColumn("_wave", wave))
    for w in range(4):
        beats.where(F.col("_wave") == w).drop("_wave").write.mode("append").parquet(f"{folder}/in")
        with state_partitions(spark):
            stream = results(hb.read_beats(spark, f"{folder}/in", fmt="parquet"))
            running = hb.append_results(stream, folder)
            running.awaitTermination()
        n_late += hb.late_beats(running)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").withColumn("n_late", F.lit(n_late).cast("long"))


@query
def session_costs_stream(spark, d):
    return _in_waves(spark, d, lambda beats: hb.session_costs(beats, HOURLY_USD, late=LATE))


@query
def rollup_stream(spark, d):
    return _in_waves(spark, d, lambda beats: hb.windowed_rollup(beats, "1 hour", LATE))
