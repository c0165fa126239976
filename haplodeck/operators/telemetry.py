"""Run telemetry over heartbeat tables: the batch side of the stream job.

A beat carries cumulative people_done / people_failed of one run. `sec` is the beat's second
since 1970. Ordered steps work on (run, hour or day) segments, so a run that holds a third of all
beats is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions.text import pct
from haplodeck.operators.prefix import segmented_lag, segmented_running
from haplodeck.operators.rows import first_per_key

DAY = 86400
RUN, ORDER = ["run_id"], ["sec", "event_id"]


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.floor(F.col("sec") / DAY))


def cumulative_beats(increments: DataFrame) -> DataFrame:
    """Beats with running counters out of one row per finished or failed person."""
    df = segmented_running(_day(increments), RUN, ORDER, "_day",
                           {"inc_done": "people_done", "inc_failed": "people_failed"})
    return df.drop("_day", "inc_done", "inc_failed")


def with_total(beats: DataFrame, run_sizes: DataFrame) -> DataFrame:
    return beats.join(run_sizes.select("run_id", "people_total"), "run_id")


def progress_metrics(beats: DataFrame, first_sec: str, hourly_usd: float) -> DataFrame:
    """elapsed_hours, rate_per_hour, remaining, eta_hours, cost from the counters of each beat."""
    hours = F.greatest((F.col("sec") - F.col(first_sec)) / 3600.0, F.lit(1e-9))
    remaining = F.greatest(F.col("people_total") - F.col("people_done"), F.lit(0))
    rate = F.col("people_done") / F.col("elapsed_hours")
    return (
        beats.withColumn("elapsed_hours", hours)
        .withColumns({"rate_per_hour": rate, "remaining": remaining})
        .withColumns({
            "eta_hours": F.when(F.col("rate_per_hour") > 0,
                                F.col("remaining") / F.col("rate_per_hour")),
            "cost_usd": F.col("elapsed_hours") * F.lit(hourly_usd),
        })
    )


def rolling_failure(prev_done: str, prev_failed: str) -> Column:
    """100 * new failures / new successes; without new successes the cumulative ratio; else 0."""
    d_done = F.greatest(F.col("people_done") - F.coalesce(prev_done, F.lit(0)), F.lit(0))
    d_failed = F.greatest(F.col("people_failed") - F.coalesce(prev_failed, F.lit(0)), F.lit(0))
    return (
        F.when(d_done > 0, d_failed * 100.0 / d_done)
        .when(F.col("people_done") > 0, F.col("people_failed") * 100.0 / F.col("people_done"))
        .otherwise(0.0)
    )


def failure_deltas(beats: DataFrame) -> DataFrame:
    """Adds the previous counters of the run, rolling_failure_pct and attempt_failure_pct (failures
    over all new outcomes)."""
    df = segmented_lag(_day(beats), RUN, ORDER, "_day",
                       {"people_done": "prev_done", "people_failed": "prev_failed"}).drop("_day")
    new_done = F.col("people_done") - F.coalesce("prev_done", F.lit(0))
    new_failed = F.col("people_failed") - F.coalesce("prev_failed", F.lit(0))
    return df.withColumns({
        "rolling_failure_pct": rolling_failure("prev_done", "prev_failed"),
        "attempt_failure_pct": pct(new_failed, new_done + new_failed),
    })


def _over(name: str, bar: float, sign: str) -> Column:
    c = F.col(name)
    hit = c > bar if sign == ">" else c < bar
    return F.when(hit, F.format_string(f"{name}=%.1f%% {sign} {bar:.0f}%%", c))


def anomaly_reason(failure_pct: float = domain.FAILURE_RATE_ANOMALY_PCT,
                   disk_pct: float = domain.DISK_DANGER_PCT,
                   mem_pct: float = domain.MEM_AVAIL_DANGER_PCT) -> Column:
    """Joined reasons, null when the beat is healthy."""
    text = F.concat_ws(
        "; ", _over("rolling_failure_pct", failure_pct, ">"), _over("disk_used_pct", disk_pct, ">"),
        _over("mem_avail_pct", mem_pct, "<"))
    return F.when(text != "", text)


def with_anomaly(beats: DataFrame, sender: tuple[str, str] | None = None) -> DataFrame:
    """anomaly flag and reason; needs rolling_failure_pct. `sender` names the flag and the reason that
    came with the beat: a flagged beat is an anomaly even where its own figures look healthy."""
    reason = anomaly_reason()
    if sender:
        flag, told = F.coalesce(F.col(sender[0]), F.lit(False)), F.trim(F.coalesce(F.col(sender[1]), F.lit("")))
        both = F.concat_ws("; ", reason, F.when(flag & (told != ""), told))
        reason = F.when(both != "", both).when(flag, "flagged by sender")
    return beats.withColumn("anomaly_reason", reason).withColumn(
        "anomaly", F.col("anomaly_reason").isNotNull())


def with_sessions(beats: DataFrame, gap_minutes: float = domain.SESSION_GAP_MINUTES) -> DataFrame:
    """session number per run; a gap longer than `gap_minutes` starts the next one."""
    df = segmented_lag(_day(beats), RUN, ORDER, "_day", {"sec": "_prev_sec"})
    fresh = F.col("_prev_sec").isNull() | (
        (F.col("sec") - F.col("_prev_sec")) / 60.0 > F.lit(float(gap_minutes)))
    df = df.withColumn("_new", fresh.cast("long"))
    return segmented_running(df, RUN, ORDER, "_day", {"_new": "session"}).drop(
        "_day", "_prev_sec", "_new")


def run_sessions(with_session: DataFrame, vm_hourly: float, disk_hourly: float) -> DataFrame:
    """Span and cost of every session."""
    hours = (F.col("last_sec") - F.col("first_sec")) / 3600.0
    return with_session.groupBy("run_id", "session").agg(
        F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"),
        F.count("*").alias("n_beats"), F.max("people_done").alias("people_done"),
        F.max("people_failed").alias("people_failed"),
    ).withColumns({"hours": hours, "vm_cost": hours * vm_hourly, "disk_cost": hours * disk_hourly,
                   "cost": hours * (vm_hourly + disk_hourly)})


def session_starts(with_session: DataFrame) -> DataFrame:
    starts = with_session.groupBy("run_id", "session").agg(F.min("sec").alias("session_first_sec"))
    return with_session.join(starts, ["run_id", "session"])


def cost_projection(beats: DataFrame, hourly_usd: float, budget_usd: float) -> DataFrame:
    """Cost since the session began, projected total and the over-budget flag per beat."""
    hours = F.greatest((F.col("sec") - F.col("session_first_sec")) / 3600.0, F.lit(0.0))
    total = F.when(F.col("eta_hours") >= 0, (hours + F.col("eta_hours")) * hourly_usd)
    return beats.withColumns({"cost_so_far": hours * hourly_usd, "projected_total": total}).withColumn(
        "over_budget", F.coalesce(F.col("projected_total") > budget_usd, F.lit(False)))


COUNTERS = ["people_done", "people_failed", "people_total"]


def alert_transitions(beats: DataFrame, stale_minutes: float, as_of_sec: int | None = None,
                      only: str | None = None, known_stale: str | None = None,
                      details: bool = False) -> DataFrame:
    """Edge-triggered alerts, one row each: finished / stopped (first terminal beat), stale (silence
    after a beat of a live run) and resumed, anomaly and cleared. `alert_sec` is when the alert
    holds: for stale the moment the silence passed the limit. With `as_of_sec`, runs that are
    silent at that second get their stale row too. `only` names a flag of the beats that may raise
    alerts, `known_stale` one of beats after which the silence has been told already. `details` adds
    the reason (of an anomaly or a silence) and the counters of the beat the alert stems from."""
    terminal = F.col("run_state").isin("complete", "failed")
    df = segmented_lag(_day(beats), RUN, ORDER, "_day",
                       {"sec": "_ps", "run_state": "_pr", "anomaly": "_pa",
                        **({known_stale: "_told"} if known_stale else {}),
                        **({c: f"_before_{c}" for c in COUNTERS} if details else {})})
    if only:
        df = df.where(only)
    told = F.coalesce("_told", F.lit(False)) if known_stale else F.lit(False)
    was_terminal = F.coalesce(F.col("_pr").isin("complete", "failed"), F.lit(False))
    limit = int(stale_minutes * 60)
    silent = F.coalesce((F.col("sec") - F.col("_ps")) > limit, F.lit(False)) & ~was_terminal
    was_bad = F.coalesce("_pa", F.lit(False))
    no_beat = silence_reason(stale_minutes)

    def event(cond: Column, kind: str, when: Column, reason: Column | None = None, of: str = "") -> Column:
        more = [
            (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
            *[F.col(f"{of}{c}").alias(c) for c in COUNTERS],
        ] if details else []
        return F.when(cond, F.struct(F.lit(kind).alias("alert"), when.alias("alert_sec"), *more))

    now = F.col("sec")
    events = F.array(
        event(silent & ~told, "stale", F.col("_ps") + limit, no_beat, "_before_"),
        event(silent, "resumed", now),
        event(terminal & ~was_terminal & (F.col("run_state") == "complete"), "finished", now),
        event(terminal & ~was_terminal & (F.col("run_state") == "failed"), "stopped", now),
        event(F.col("anomaly") & ~was_bad, "anomaly", now, F.col("anomaly_reason") if details else None),
        event(~F.col("anomaly") & was_bad, "cleared", now),
    )
    out = df.withColumn("_e", F.explode(F.filter(events, lambda e: e.isNotNull()))).select("run_id", "_e.*")
    if as_of_sec is None:
        return out
    more = COUNTERS if details else []
    last = beats.groupBy(*RUN).agg(F.max(F.struct(*ORDER, "run_state", *more)).alias("_l"))
    quiet = last.where(
        ~F.col("_l.run_state").isin("complete", "failed")
        & (F.lit(as_of_sec) > F.col("_l.sec") + limit)
    ).select("run_id", F.lit("stale").alias("alert"), (F.col("_l.sec") + limit).alias("alert_sec"),
             *([no_beat.alias("reason")] if details else []), *[F.col(f"_l.{c}") for c in more])
    return out.unionByName(quiet)


def silence_reason(stale_minutes: float) -> Column:
    return F.lit(f"no beat for more than {stale_minutes:.0f} min")


def current_status(beats: DataFrame, now_sec: int | Column, stale_minutes: float) -> DataFrame:
    """Status of every run from its last beat: complete, failed, starting, stale, anomaly, running."""
    last = first_per_key(beats, RUN, [F.col(o).desc() for o in ORDER])
    now = F.lit(now_sec) if isinstance(now_sec, int) else now_sec
    status = (
        F.when(F.col("run_state") == "complete", "COMPLETE")
        .when(F.col("run_state") == "failed", "STOPPED")
        .when(F.col("run_state") == "starting", "STARTING")
        .when((now - F.col("sec")) / 60.0 > stale_minutes, "STALE")
        .when(F.col("anomaly"), "ANOMALY").otherwise("RUNNING")
    )
    return last.select("run_id", "event_id", "sec", "run_state", status.alias("status"),
                       "people_done", "people_failed")


def session_history(with_session: DataFrame, points: int = domain.CHART_MAX_POINTS) -> DataFrame:
    """The last `points` beats of each run's current session, as a chart series."""
    current = with_session.groupBy("run_id").agg(F.max("session").alias("session"))
    rows = with_session.join(current, ["run_id", "session"], "left_semi")
    return first_per_key(rows, RUN, [F.col(o).desc() for o in ORDER], points)


def attempt_state(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Failures, done and given-up flags per person out of the attempt log (ok boolean)."""
    out = attempts.groupBy("person_id").agg(
        F.count_if(~F.col("ok")).alias("n_failed"), F.bool_or("ok").alias("done"))
    return out.withColumn("given_up", ~F.col("done") & (F.col("n_failed") >= max_attempts))


def tumbling_rollup(beats: DataFrame, minutes: int = 5) -> DataFrame:
    """Latest counters and worst resources per run and time bucket."""
    width = minutes * 60
    return beats.groupBy("run_id", (F.floor(F.col("sec") / width) * width).alias("bucket_sec")).agg(
        F.count("*").alias("n_beats"), F.max("people_done").alias("people_done"),
        F.max("people_failed").alias("people_failed"),
        F.max("disk_used_pct").alias("max_disk_used_pct"),
        F.min("mem_avail_pct").alias("min_mem_avail_pct"))
