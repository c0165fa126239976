"""The stream gives the same rows as the batch operators on the same beats."""

import random

import pytest
from pyspark.sql import functions as F

from haplodeck.operators import telemetry as te
from haplodeck.streaming import heartbeats as hb
from haplodeck.streaming import ingest as ig

START = 1_700_000_000


@pytest.fixture(scope="module")
def beats(spark, tmp_path_factory):
    rng = random.Random(5)
    rows, n = [], 0
    for run in (1, 2, 3):
        sec, done, failed = START + run * 7, 0, 0
        for i in range(60):
            sec += rng.choice([300, 300, 300, 9000])
            done += rng.randrange(0, 4)
            failed += rng.randrange(0, 2)
            state = "complete" if (run, i) in ((1, 59), (2, 30)) else "failed" if (run, i) == (2, 59) else "running"
            rows.append((run, n, sec, state, done, failed, float(rng.randrange(60, 100)), float(rng.randrange(5, 60))))
            n += 1
    df = spark.createDataFrame(rows, "run_id long, event_id long, sec long, run_state string, people_done long, "
                                     "people_failed long, disk_used_pct double, mem_avail_pct double")
    path = str(tmp_path_factory.mktemp("beats") / "in")
    df.select("run_id", "event_id", F.timestamp_seconds("sec").alias("ts"), "run_state",
              F.lit(None).cast("string").alias("phase"), F.lit(0).cast("long").alias("people_total"), "people_done",
              "people_failed", "disk_used_pct", "mem_avail_pct").coalesce(1).write.json(path)
    return df, path


def run(stream, tmp_path):
    out = str(tmp_path / "out")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_alerts_equal_batch(spark, beats, tmp_path):
    df, path = beats
    last = df.agg(F.max("sec")).first()[0]
    batch = te.alert_transitions(te.with_anomaly(te.failure_deltas(df)), 60, last - 600)
    want = sorted(tuple(r) for r in batch.collect())
    hb.run_alerts(hb.read_beats(spark, path), str(tmp_path / "one"), 60).awaitTermination()
    got = sorted(tuple(r) for r in hb.read_alerts(spark, str(tmp_path / "one")).collect())
    assert got == want and {a for _, a, _ in got} == {
        "stale", "resumed", "finished", "stopped", "anomaly", "cleared"}


def test_alerts_over_several_batches(spark, beats, tmp_path):
    df, _ = beats
    last = df.agg(F.max("sec")).first()[0]
    wide = df.select("run_id", "event_id", F.timestamp_seconds("sec").alias("ts"), "run_state",
                     F.lit(None).cast("string").alias("phase"), F.lit(0).cast("long").alias("people_total"),
                     "people_done", "people_failed", "disk_used_pct", "mem_avail_pct")
    source, folder = str(tmp_path / "in"), str(tmp_path / "several")
    first, fifth = df.agg(F.min("sec")).first()[0], (last - df.agg(F.min("sec")).first()[0]) // 5
    for i in range(5):  # in time order; a beat that comes again is ignored
        since, until = first + fifth * i - 1000 * (i > 0), first + fifth * (i + 1) + 5 * (i == 4)
        part = wide.where(f"unix_seconds(ts) between {since} and {until}")
        part.coalesce(1).write.mode("append").json(source)
        hb.run_alerts(hb.read_beats(spark, source), folder, 60).awaitTermination()
    want = sorted(tuple(r) for r in te.alert_transitions(te.with_anomaly(te.failure_deltas(df)), 60, last - 600).collect())
    assert sorted(tuple(r) for r in hb.read_alerts(spark, folder).collect()) == want


def test_session_gap_of_exactly_the_limit(spark):
    rows = [(1, i, s, 0, 0) for i, s in enumerate((0, 5400, 10801))]
    df = spark.createDataFrame(rows, "run_id long, event_id long, sec long, people_done long, people_failed long")
    assert [r.session for r in te.with_sessions(df, 90).orderBy("sec").collect()] == [1, 1, 2]


def test_rollup_equals_batch_up_to_the_watermark(spark, beats, tmp_path):
    df, path = beats
    last = df.agg(F.max("sec")).first()[0]
    want = {tuple(r) for r in te.tumbling_rollup(df, 5).collect() if r.bucket_sec + 300 <= last - 600}
    got = {tuple(r) for r in run(hb.windowed_rollup(hb.read_beats(spark, path)), tmp_path).collect()}
    assert got == want


def test_closed_sessions_equal_batch(spark, beats, tmp_path):
    df, path = beats
    last = df.agg(F.max("sec")).first()[0]
    batch = te.run_sessions(te.with_sessions(df, 90), 1.0, 0.5)
    want = {(r.run_id, r.first_sec, r.last_sec, r.n_beats, round(r.cost, 6)) for r in batch.collect()
            if r.last_sec + 5400 <= last - 600}
    got = {(r.run_id, r.first_sec, r.last_sec, r.n_beats, round(r.cost, 6))
           for r in run(hb.session_costs(hb.read_beats(spark, path), 1.5), tmp_path).collect()}
    assert got == want


def test_append_sink_is_exactly_once(spark, beats, tmp_path):
    df, path = beats
    for _ in range(2):
        hb.append_beats(hb.read_beats(spark, path), str(tmp_path / "o"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == df.count()


BEAT = ("run_id long, event_id long, ts string, run_state string, people_done long, people_failed long, "
        "people_total long, disk_used_pct double, mem_avail_pct double, anomaly boolean, anomaly_reason string")


def put_beats(spark, path, rows):
    """rows: (run, event, second, state, flag, reason); healthy figures."""
    spark.createDataFrame([(r, e, s, st, e, 0, 99, 10.0, 50.0, f, why) for r, e, s, st, f, why in rows],
                          BEAT.replace("ts string", "sec long")).select(
        "run_id", "event_id", F.timestamp_seconds("sec").alias("ts"), "run_state", "people_done", "people_failed",
        "people_total", "disk_used_pct", "mem_avail_pct", "anomaly", "anomaly_reason",
    ).write.mode("append").json(path)


def test_silence_of_every_run_is_told_once(spark, tmp_path):
    source, ticked, folder = (str(tmp_path / n) for n in ("in", "ticks", "out"))
    put_beats(spark, source, [(1, 1, START, "running", None, None), (2, 2, START + 60, "complete", None, None)])

    def tick(sec):
        spark.createDataFrame([(sec,)], "tick_sec long").write.mode("append").parquet(ticked)
        hb.run_alerts(hb.read_beats(spark, source), folder, 60,
                      ticks=spark.readStream.schema("tick_sec long").parquet(ticked)).awaitTermination()
        return sorted((r.run_id, r.alert, r.alert_sec) for r in hb.read_alerts(spark, folder).collect())

    finished = [(2, "finished", START + 60)]
    assert tick(START + 100) == finished
    assert tick(START + 3600 + 600) == finished  # not yet beyond the limit and the allowed lateness
    stale = [(1, "stale", START + 3600), *finished]
    assert tick(START + 3600 + 601) == stale
    assert tick(START + 90000) == stale
    put_beats(spark, source, [(1, 3, START + 90001, "running", None, None)])
    assert tick(START + 90002) == sorted([*stale, (1, "resumed", START + 90001)])
    details = {(r.alert, r.reason, r.people_done, r.people_total) for r in hb.read_alerts(spark, folder, True).collect()}
    assert ("stale", "no beat for more than 60 min", 1, 99) in details and ("finished", None, 2, 99) in details


def test_wall_clock_ticks_find_a_dead_stream(spark, tmp_path):
    import time

    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put_beats(spark, source, [(7, 1, START, "running", None, None)])
    running = hb.run_alerts(hb.read_beats(spark, source), folder, 60, ticks=hb.processing_ticks(spark, 1),
                            processingTime="1 second")
    try:
        until = time.time() + 90
        while time.time() < until and running.isActive:
            try:
                if hb.read_alerts(spark, folder).count():
                    break
            except Exception:  # nothing written yet
                pass
            time.sleep(1)
        assert [tuple(r) for r in hb.read_alerts(spark, folder).collect()] == [(7, "stale", START + 3600)]
    finally:
        running.stop()


def test_flags_of_the_sender(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put_beats(spark, source, [(1, 1, START, "running", True, None), (1, 2, START + 9, "running", False, "ignored"),
                              (1, 3, START + 20, "running", True, " queue stuck ")])
    hb.run_alerts(hb.read_beats(spark, source), folder, 60).awaitTermination()
    got = sorted((r.alert_sec - START, r.alert, r.reason) for r in hb.read_alerts(spark, folder, details=True).collect())
    assert got == [(0, "anomaly", "flagged by sender"), (9, "cleared", None), (20, "anomaly", "queue stuck")]


def test_state_of_many_batches_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hb, "FULL_STATE_EVERY", 2)
    source, folder = str(tmp_path / "in"), tmp_path / "out"
    for i in range(7):
        put_beats(spark, source, [(1 + i % 3, i, START + 10 * i, "complete" if i == 6 else "running", None, None)])
        hb.run_alerts(hb.read_beats(spark, source), str(folder), 60).awaitTermination()
    states = sorted(int(p.name.split("=")[1]) for p in (folder / "state").iterdir())
    assert states[0] > 0 and states[-1] == 6
    assert {r.run_id: r.event_id for r in hb._last_state(spark, str(folder), 7).collect()} == {1: 6, 2: 4, 3: 5}
    assert [tuple(r) for r in hb.read_alerts(spark, str(folder)).collect()] == [(1, "finished", START + 60)]


def lines_of(*rows):
    return [r if isinstance(r, str) else '{"received_ts": %s, "payload": {"run_id": %d, "event_id": %d, "ts": "%s", '
            '"run_state": "running", "people_done": %d}}' % r for r in rows]


def ingested(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
    ig.ingest(ig.read_lines(spark, f"{folder}/in"), folder).awaitTermination()
    beats = sorted((r.run_id, r.event_id, r.people_done) for r in ig.read_stored(spark, folder).collect())
    broken = sorted((r.reason, r.line) for r in ig.read_quarantine(spark, folder).collect())
    told = [tuple(r) for r in ig.read_ledger(spark, folder).orderBy("batch").select(
        "n_blank", "n_stored", "n_replayed", "n_quarantined").collect()]
    return beats, broken, told


def test_ingest_keeps_every_line_somewhere_and_survives_a_repeated_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    day = "2024-03-0{}T10:00:00.000Z".format
    bad = ['{"received_ts": 1, "payl', '{"received_ts": 1}', lines_of((1, 1, 9, "soon", 1))[0],
           lines_of((1, 1, 9, day(1), -4))[0], '{"received_ts": 1, "payload": {"event_id": 3, "ts": "2024-03-01"}}',
           '{"received_ts": 1, "payload": {"run_id": "x", "event_id": 3, "ts": "2024-03-01"}}']
    first = lines_of((10, 1, 1, day(1), 5), (11, 1, 1, day(1), 5), (12, 2, 1, day(2), 6)) + ["", "  ", *bad]
    beats, broken, told = ingested(spark, folder, first)
    assert beats == [(1, 1, 5), (2, 1, 6)] and told == [(2, 2, 1, 6)]
    assert sorted(line for _, line in broken) == sorted(bad)
    assert {r for r, _ in broken} == {"not json", "no payload", "no time", "negative count", "no run or event"}
    again = lines_of((20, 1, 1, day(1), 5), (21, 1, 2, day(3), 7))
    want = ([(1, 1, 5), (1, 2, 7), (2, 1, 6)], broken, [(2, 2, 1, 6), (0, 1, 1, 0)])
    assert ingested(spark, folder, again) == want
    # the second batch loses its commit, as in a crash after writing: it runs again and replaces its rows
    for name in ("commits/1", "commits/.1.crc"):
        path = tmp_path / "log" / "progress" / name
        if path.exists():
            path.unlink()
    ig.ingest(ig.read_lines(spark, f"{folder}/in"), folder).awaitTermination()
    assert sorted((r.run_id, r.event_id, r.people_done) for r in ig.read_stored(spark, folder).collect()) == want[0]
    assert [tuple(r)[:4] for r in ig.read_ledger(spark, folder).orderBy("batch").collect()] == want[2]


def test_recovered_state_takes_the_current_session(spark):
    rows = [(1, i, s, "running", i, 0) for i, s in enumerate((0, 100, 5500, 10901, 10950))] + [(2, 9, 7, "failed", 1, 1)]
    df = spark.createDataFrame(rows, "run_id long, event_id long, sec long, run_state string, people_done long, people_failed long")
    got = sorted(tuple(r) for r in ig.recovered_state(df, points=1).collect())
    assert got == [(1, 4, 10950, "running", 4, 0, 10901, 1), (2, 9, 7, "failed", 1, 1, 7, 1)]


def test_event_time_streams_drop_and_count_late_beats(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    waves = [[0, 5400, 10801, 16201], [5401, 12600, 16202, 40000], [39000, 34001, 33999, 90000]]
    late = 0
    for w, secs in enumerate(waves):  # allowed lateness 6000 s: wave 1 is late up to 10201, wave 2 up to 34000
        put_beats(spark, source, [(1, 10 * w + i, START + s, "running", None, None) for i, s in enumerate(secs)])
        stream = hb.session_costs(hb.read_beats(spark, source), 1.0, late="6000 seconds")
        running = hb.append_results(stream, folder)
        running.awaitTermination()
        late += hb.late_beats(running)
    got = sorted((r.first_sec - START, r.last_sec - START, r.n_beats)
                 for r in spark.read.schema(stream.schema).parquet(f"{folder}/rows").collect())
    # 0 and 5400 are exactly 90 minutes apart: one session; 10801 begins the next
    assert got == [(0, 5400, 2), (10801, 16202, 4), (34001, 40000, 3)] and late == 2
