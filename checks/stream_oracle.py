"""DuckDB statements for the queries of `plans/streams.py`."""

from checks.oracle import BEATS

ORACLE: dict[str, str] = {}

ORACLE["alert_messages"] = f"""WITH {BEATS},
s AS (SELECT *, event_id % 173 = 0 OR event_id % 179 = 0 AS flag, run_id * 1000 AS total FROM bad),
t AS (SELECT * EXCLUDE (anomaly), anomaly OR flag AS anomaly, concat_ws('; ',
  CASE WHEN rfp > 15 THEN 'rolling_failure_pct=#% > 15%' END, CASE WHEN disk > 90 THEN 'disk_used_pct=#% > 90%' END,
  CASE WHEN mem < 10 THEN 'mem_avail_pct=#% < 10%' END, CASE WHEN event_id % 173 = 0 THEN 'queue stuck' END) AS why FROM s),
z AS (SELECT *, coalesce(lag(anomaly) OVER w, false) AS pbad, coalesce(pstate IN ('complete', 'failed'), false) AS pterm,
  lag(done) OVER w AS ld, lag(failed) OVER w AS lf, row_number() OVER (PARTITION BY run_id ORDER BY sec DESC, event_id DESC) AS rn
  FROM t WINDOW w AS (PARTITION BY run_id ORDER BY sec, event_id)),
silence AS (SELECT 'no beat for more than 120 min' AS reason)
SELECT run_id, 'stale' AS alert, psec + 7200 AS alert_sec, reason, ld AS people_done, lf AS people_failed, total AS people_total
  FROM z, silence WHERE NOT pterm AND sec - psec > 7200
UNION ALL SELECT run_id, 'resumed', sec, NULL, done, failed, total FROM z WHERE NOT pterm AND sec - psec > 7200
UNION ALL SELECT run_id, 'finished', sec, NULL, done, failed, total FROM z WHERE run_state = 'complete' AND NOT pterm
UNION ALL SELECT run_id, 'stopped', sec, NULL, done, failed, total FROM z WHERE run_state = 'failed' AND NOT pterm
UNION ALL SELECT run_id, 'anomaly', sec, CASE WHEN why <> '' THEN why ELSE 'flagged by sender' END, done, failed, total
  FROM z WHERE anomaly AND NOT pbad
UNION ALL SELECT run_id, 'cleared', sec, NULL, done, failed, total FROM z WHERE NOT anomaly AND pbad
UNION ALL SELECT run_id, 'stale', sec + 7200, reason, done, failed, total FROM z, silence
  WHERE rn = 1 AND run_state NOT IN ('complete', 'failed')"""

LINES = f"""{BEATS}, lines AS (
  SELECT *, CASE WHEN event_id % 73 = 0 THEN 'blank' WHEN event_id % 53 = 0 THEN 'not json' WHEN event_id % 71 = 0 THEN 'no payload'
    WHEN event_id % 59 = 0 THEN 'no run or event' WHEN event_id % 61 = 0 THEN 'no time'
    WHEN event_id % 67 = 0 THEN 'negative count' ELSE 'stored' END AS kind, event_id % 41 = 0 AS again FROM b)"""
ORACLE["beat_ingest"] = f"""WITH {LINES}
SELECT kind, run_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS event_sum FROM lines WHERE kind = 'stored' GROUP BY 1, 2
UNION ALL SELECT kind, NULL, CAST(count(*) + count(*) FILTER (WHERE again) AS BIGINT), NULL FROM lines
  WHERE kind NOT IN ('stored', 'blank') GROUP BY 1
UNION ALL SELECT 'blank', NULL, CAST(coalesce(sum(1 + again::INT), 0) AS BIGINT), NULL FROM lines WHERE kind = 'blank'
UNION ALL SELECT 'replayed', NULL, count(*), NULL FROM lines WHERE kind = 'stored' AND again"""
ORACLE["history_reload"] = f"""WITH {LINES},
g AS (SELECT *, lag(sec) OVER (PARTITION BY run_id ORDER BY sec, event_id) AS gsec FROM lines WHERE kind = 'stored'),
n AS (SELECT *, sum(CASE WHEN gsec IS NULL OR sec - gsec > 5400 THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS se FROM g),
c AS (SELECT *, max(se) OVER (PARTITION BY run_id) AS cur FROM n),
m AS (SELECT *, min(sec) OVER (PARTITION BY run_id) AS first, count(*) OVER (PARTITION BY run_id) AS k,
  row_number() OVER (PARTITION BY run_id ORDER BY sec DESC, event_id DESC) AS rn FROM c WHERE se = cur)
SELECT run_id, event_id, sec AS last_sec, run_state, done AS people_done, failed AS people_failed,
  first AS session_first_sec, least(k, 500) AS n_points FROM m WHERE rn = 1"""

# A beat is late if the newest beat of all earlier waves is at least two hours ahead of it.
WAVES = f"""{BEATS}, wv AS (SELECT *, least((day(to_timestamp(sec) AT TIME ZONE 'UTC') - 1) // 10, 2) + (event_id % 37 = 0)::INT AS wave FROM b),
clock AS (SELECT w.wave, (SELECT max(sec) FROM wv x WHERE x.wave < w.wave) - 7200 AS mark FROM (SELECT DISTINCT wave FROM wv) w),
kept AS (SELECT wv.* FROM wv JOIN clock USING (wave) WHERE mark IS NULL OR sec > mark),
totals AS (SELECT max(sec) - 7200 AS final, count(*) - (SELECT count(*) FROM kept) AS n_late FROM wv)"""
ORACLE["session_costs_stream"] = f"""WITH {WAVES},
g AS (SELECT *, lag(sec) OVER (PARTITION BY run_id ORDER BY sec, event_id) AS gsec FROM kept),
n AS (SELECT *, sum(CASE WHEN gsec IS NULL OR sec - gsec > 5400 THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS se FROM g),
c AS (SELECT run_id, se, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS n_beats FROM n GROUP BY 1, 2)
SELECT run_id, first_sec, last_sec, n_beats, round((last_sec - first_sec) / CAST(3600 AS DOUBLE) * CAST(1.3 AS DOUBLE), 6) AS cost, n_late
FROM c, totals WHERE last_sec + 5400 < final"""
ORACLE["rollup_stream"] = f"""WITH {WAVES},
c AS (SELECT run_id, sec // 3600 * 3600 AS bucket_sec, count(*) AS n_beats, max(done) AS people_done, max(failed) AS people_failed,
  round(max(disk), 6) AS max_disk_used_pct, round(min(mem), 6) AS min_mem_avail_pct FROM kept GROUP BY 1, 2)
SELECT c.*, n_late FROM c, totals WHERE bucket_sec + 3600 <= final"""
