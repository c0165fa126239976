"""Durable ingest of heartbeat lines: parse, quarantine, append exactly once, recover after a restart.

A line is one JSON record: the second it was received and the beat as `payload`. Every micro-batch writes
under its own number, so a batch that is repeated after a failure replaces what it had written. A beat that
was sent again (same run and event) is recognised against the days it falls on and kept apart; a line that
cannot be used is kept as it came, with the reason. Blank lines are counted and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haplodeck import domain
from haplodeck.operators import telemetry as te
from haplodeck.operators.rows import first_per_key
from haplodeck.session import cut_lineage
from haplodeck.streaming.heartbeats import BEAT_SCHEMA

RECORD_SCHEMA = (
    "received_ts double, payload struct<run_id: bigint, event_id: bigint, ts: string, run_state: string, "
    "phase: string, people_total: bigint, people_done: bigint, people_failed: bigint, disk_used_pct: double, "
    "mem_avail_pct: double, anomaly: boolean, anomaly_reason: string>"
)
STORED_SCHEMA = f"{BEAT_SCHEMA}, received_sec long, day date, batch long"
BROKEN_SCHEMA = "line string, reason string, batch long"
KEY = ["run_id", "event_id"]


def read_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of text lines of a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def beat_lines(beats: DataFrame) -> DataFrame:
    """The sender's side: one `value` per beat, with the second of `received_sec`."""
    payload = [c.split()[0] for c in BEAT_SCHEMA.split(", ")]
    return beats.select(F.to_json(F.struct(
        F.col("received_sec").cast("double").alias("received_ts"),
        F.struct(*[F.col(c) for c in payload]).alias("payload"))).alias("value"))


def _broken_reason() -> Column:
    p = F.col("r.payload")
    return (
        F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "not json")
        .when(p.isNull(), "no payload")
        .when(p.run_id.isNull() | p.event_id.isNull(), "no run or event")
        .when(F.col("_ts").isNull(), "no time")
        .when((F.coalesce(p.people_done, F.lit(0)) < 0) | (F.coalesce(p.people_failed, F.lit(0)) < 0), "negative count")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """reason (null for a usable line), line and the beat's columns. A line is broken if it is no JSON
    record of the expected types, has no payload, run, event or time, or counts below zero."""
    record = F.from_json("value", f"{RECORD_SCHEMA}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.where(F.trim("value") != "").select(F.col("value").alias("line"), record.alias("r")).withColumn(
        "_ts", F.col("r.payload.ts").try_cast("timestamp")).withColumn("reason", _broken_reason())
    names = [c.split()[0] for c in BEAT_SCHEMA.split(", ")]
    return parsed.select(
        "reason", "line", *[(F.col("_ts") if c == "ts" else F.col(f"r.payload.{c}")).alias(c) for c in names],
        F.floor("r.received_ts").cast("long").alias("received_sec"), F.to_date("_ts").alias("day"))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(f"{folder}/beats")


def _append(new: DataFrame, batch: int, folder: str) -> None:
    """One micro-batch. Its beats are compared with stored ones of the same days only; what an earlier
    attempt at this batch wrote does not count as stored."""
    spark = new.sparkSession
    n_blank = new.where(F.coalesce(F.trim("value"), F.lit("")) == "").count()
    rows = cut_lineage(parse_lines(new))
    good = rows.where("reason is null").drop("reason", "line")
    once = cut_lineage(first_per_key(
        good.withColumn("_order", F.monotonically_increasing_id()), KEY, [F.col("received_sec").asc_nulls_last(), F.col("_order")]
    ).drop("_order"))
    fresh, first, last = once, *once.agg(F.min("day"), F.max("day")).first()
    if batch and first is not None:
        seen = _stored(spark, folder).where(
            (F.col("batch") < batch) & F.col("day").between(first, last)).select(*KEY)
        fresh = once.join(seen, KEY, "left_anti")
    fresh = fresh.withColumn("batch", F.lit(batch).cast("long"))

    def put(df: DataFrame, what: str, *parts: str) -> None:
        writer = df.drop("batch").write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{folder}/{what}/batch={batch}")

    put(fresh, "beats", "day")
    put(rows.where("reason is not null").select("line", "reason"), "quarantine")
    n_fresh = spark.read.schema(STORED_SCHEMA).parquet(f"{folder}/beats/batch={batch}").count()
    n_good, n_all = good.count(), rows.count()
    put(spark.createDataFrame([(n_blank, n_fresh, n_good - n_fresh, n_all - n_good)],
                              "n_blank long, n_stored long, n_replayed long, n_quarantined long"), "ledger")


def ingest(lines: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Lines into `folder`/beats (by batch and day), /quarantine and /ledger."""
    def handle(new: DataFrame, batch: int) -> None:
        _append(new, batch, folder)

    return lines.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def read_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Stored beats, each once, with `sec`."""
    return _stored(spark, folder).drop("batch", "day").withColumn("sec", F.unix_seconds("ts"))


def read_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BROKEN_SCHEMA).parquet(f"{folder}/quarantine")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """n_blank, n_stored, n_replayed, n_quarantined of every batch."""
    return spark.read.parquet(f"{folder}/ledger")


def recovered_state(beats: DataFrame, points: int = domain.CHART_MAX_POINTS,
                    gap_minutes: float = domain.SESSION_GAP_MINUTES) -> DataFrame:
    """What a receiver needs after a restart, from the stored beats: per run the last beat, the second the
    current session (and so the cost clock) began, and how many beats of it a chart can show."""
    sessions = te.with_sessions(beats, gap_minutes)
    per = sessions.groupBy("run_id", "session").agg(
        F.min("sec").alias("session_first_sec"), F.count("*").alias("_n"),
        F.max(F.struct("sec", "event_id", "run_state", "people_done", "people_failed")).alias("_l"))
    last = first_per_key(per, ["run_id"], [F.col("session").desc()])
    return last.select("run_id", F.col("_l.event_id").alias("event_id"), F.col("_l.sec").alias("last_sec"),
                       F.col("_l.run_state").alias("run_state"), F.col("_l.people_done").alias("people_done"),
                       F.col("_l.people_failed").alias("people_failed"), "session_first_sec",
                       F.least("_n", F.lit(points).cast("long")).alias("n_points"))
