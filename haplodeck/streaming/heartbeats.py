"""Heartbeat stream: ingest, windowed roll-up, session cost and alerts.

Event time is `ts`. Roll-up and sessions drop beats later than the watermark. For alerts, beats of a run
are taken in (second, event_id) order and one that is not newer than the last one handled is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haplodeck import domain
from haplodeck.operators import telemetry as te
from haplodeck.operators.rows import first_per_key
from haplodeck.session import cut_lineage

BEAT_SCHEMA = (
    "run_id long, event_id long, ts timestamp, run_state string, phase string, "
    "people_total long, people_done long, people_failed long, "
    "disk_used_pct double, mem_avail_pct double, anomaly boolean, anomaly_reason string"
)
ALERT_SCHEMA = (
    "run_id long, alert string, alert_sec long, reason string, people_done long, people_failed long, "
    "people_total long"
)
STATE_SCHEMA = (
    "run_id long, event_id long, sec long, run_state string, people_done long, people_failed long, "
    "people_total long, disk_used_pct double, mem_avail_pct double, anomaly boolean, stale boolean"
)
#: Every so many batches the state of all runs is written; in between, that of the changed ones.
FULL_STATE_EVERY = 20


def read_beats(spark: SparkSession, path: str, files_per_trigger: int | None = None,
               fmt: str = "json") -> DataFrame:
    """File-source stream of heartbeats with a fixed schema."""
    reader = spark.readStream.schema(BEAT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def append_beats(beats: DataFrame, path: str, checkpoint: str):
    """Durable append of every beat, exactly once, one folder per day."""
    return (
        beats.withColumn("day", F.to_date("ts")).writeStream.format("parquet")
        .partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def on_time(beats: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Beats that came before the watermark passed them, each (run, event) once. The operator counts
    the rows it drops as late, one by one, so `late_beats` can tell them."""
    return beats.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "event_id"])


def late_beats(query: StreamingQuery) -> int:
    """Beats the stream's `on_time` dropped as late, over the progress the session keeps (the setting
    spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators
               if op.operatorName.startswith("dedupe"))


def windowed_rollup(beats: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Latest counters and worst resources per run and tumbling window."""
    return (
        on_time(beats, late).groupBy("run_id", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n_beats"), F.max("people_done").alias("people_done"),
             F.max("people_failed").alias("people_failed"),
             F.max("disk_used_pct").alias("max_disk_used_pct"),
             F.min("mem_avail_pct").alias("min_mem_avail_pct"))
        .select("run_id", F.unix_seconds("w.start").alias("bucket_sec"), "n_beats", "people_done",
                "people_failed", "max_disk_used_pct", "min_mem_avail_pct")
    )


def session_costs(beats: DataFrame, hourly_usd: float,
                  gap_minutes: int = domain.SESSION_GAP_MINUTES,
                  late: str = "10 minutes") -> DataFrame:
    """Span and cost of every run session; a silence of more than `gap_minutes` ends one. A window of
    Spark ends a session at a gap of exactly its length, so it is a microsecond longer."""
    out = on_time(beats, late).groupBy(
        "run_id", F.session_window("ts", f"{gap_minutes} minutes 1 microsecond")
    ).agg(F.count("*").alias("n_beats"), F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    hours = (F.unix_micros("_b") - F.unix_micros("_a")) / 3.6e9
    return out.select("run_id", F.unix_seconds("_a").alias("first_sec"),
                      F.unix_seconds("_b").alias("last_sec"), "n_beats",
                      (hours * hourly_usd).alias("cost"))


def append_results(rows: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Closed windows or sessions appended to `folder`/rows, exactly once."""
    return rows.writeStream.format("parquet").option("path", f"{folder}/rows").option(
        "checkpointLocation", f"{folder}/progress").outputMode("append").trigger(
        **(trigger or {"availableNow": True})).start()


def _last_state(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """Last row per run as of the batches before this one; empty at the start."""
    if batch == 0:
        return spark.createDataFrame([], STATE_SCHEMA)
    full = batch - 1 - (batch - 1) % FULL_STATE_EVERY
    rows = None
    for b in range(full, batch):
        part = spark.read.schema(STATE_SCHEMA).parquet(f"{folder}/state/batch={b}").withColumn("_batch", F.lit(b))
        rows = part if rows is None else rows.unionByName(part)
    return first_per_key(rows, ["run_id"], [F.col("_batch").desc()]).drop("_batch")


def _forget_states(spark: SparkSession, folder: str, batch: int) -> None:
    """Removes the states that no batch from here on, nor a repetition of this one, reads."""
    for b in range(max(0, batch - 2 * FULL_STATE_EVERY), batch - FULL_STATE_EVERY):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/batch={b}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _handle(new: DataFrame, batch: int, folder: str, limit: int, late_seconds: int) -> None:
    """One micro-batch: each run's last row goes in front of its new beats, and the batch operators do
    the rest. Both results are written under the batch's number, so a repeated batch replaces them.
    Ticks bring no rows, only a later "now"; a batch of ticks alone still finds the silent runs."""
    spark = new.sparkSession
    held = _last_state(spark, folder, batch)
    columns = ["run_id", "event_id", "sec", "run_state", "people_done", "people_failed", "people_total",
               "disk_used_pct", "mem_avail_pct"]
    fresh = new.where("tick_sec is null").withColumn("sec", F.unix_seconds("ts")).alias("n").join(
        held.select("run_id", F.struct("sec", "event_id").alias("_seen")), "run_id", "left").where(
        F.col("_seen").isNull() | (F.struct("sec", "event_id") > F.col("_seen"))).select(
        *columns, F.col("anomaly").alias("_flag"), F.col("anomaly_reason").alias("_told"),
        F.lit(False).alias("stale"), F.lit(True).alias("_new"))
    rows = cut_lineage(held.select(*columns, "stale", F.lit(False).alias("_new")).unionByName(
        fresh, allowMissingColumns=True))
    flagged = te.with_anomaly(te.failure_deltas(rows), sender=("_flag", "_told"))
    newest = max((x for x in (rows.agg(F.max("sec")).first()[0], new.agg(F.max("tick_sec")).first()[0])
                  if x is not None), default=None)
    # the first row of a run that comes from the state has lost its own predecessor; it is not judged anew
    before = held.select("run_id", F.col("anomaly").alias("_held_bad"))
    judged = flagged.join(before, "run_id", "left").withColumn(
        "anomaly", F.when(F.col("_new"), F.col("anomaly")).otherwise(F.col("_held_bad"))).drop("_held_bad", "_told")
    judged = cut_lineage(judged)
    alerts = te.alert_transitions(judged, limit / 60, only="_new", known_stale="stale", details=True)
    last = first_per_key(judged, ["run_id"], [F.col("sec").desc(), F.col("event_id").desc()])
    quiet = ~F.coalesce(F.col("run_state").isin("complete", "failed"), F.lit(False)) & ~F.col("stale") & (
        F.lit(newest - late_seconds if newest is not None else 0) > F.col("sec") + limit)
    state = cut_lineage(last.withColumn("_quiet", quiet))
    silent = state.where("_quiet").select(
        "run_id", F.lit("stale").alias("alert"), (F.col("sec") + limit).alias("alert_sec"),
        te.silence_reason(limit / 60).alias("reason"), *te.COUNTERS)
    alerts.unionByName(silent).write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch}")
    full = batch % FULL_STATE_EVERY == 0
    (state if full else state.where("_new or _quiet")).select(
        *columns, "anomaly", (F.col("stale") | F.col("_quiet")).alias("stale")).write.mode(
        "overwrite").parquet(f"{folder}/state/batch={batch}")
    if full:
        _forget_states(spark, folder, batch)


def processing_ticks(spark: SparkSession, seconds: int = 60) -> DataFrame:
    """tick_sec, one row about every `seconds` of wall-clock time, whether beats arrive or not."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(
        F.unix_seconds("timestamp").alias("tick_sec")).where(F.col("tick_sec") % seconds == 0)


def run_alerts(beats: DataFrame, folder: str, stale_minutes: float, late_minutes: int = 10,
               ticks: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Alert rows as runs change state: anomaly / cleared, stale / resumed, finished / stopped, written
    to `folder`/alerts. The state kept between batches is the last row of every run. A run is stale
    once "now" is `late_minutes` beyond its limit; now is the newest beat of all runs or, with a stream of
    `ticks` (tick_sec), the newest tick, so that the silence of all runs is told as well. Every
    silence is told once. `trigger` goes to the stream's trigger; the default is one pass over what
    there is. A run with most of the beats is cut into days like any other, and no Python runs per run or row."""
    limit, late = int(stale_minutes * 60), late_minutes * 60
    both = beats.withColumn("tick_sec", F.lit(None).cast("long"))
    if ticks is not None:
        both = both.unionByName(ticks.select(F.col("tick_sec").cast("long")), allowMissingColumns=True)

    def handle(new: DataFrame, batch: int) -> None:
        _handle(new, batch, folder, limit, late)

    return both.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def read_alerts(spark: SparkSession, folder: str, details: bool = False) -> DataFrame:
    """run_id, alert, alert_sec; with `details` the reason and the run's counters too."""
    found = spark.read.schema(ALERT_SCHEMA).parquet(f"{folder}/alerts")
    return found.select("run_id", "alert", "alert_sec", *(["reason", *te.COUNTERS] if details else []))
