"""Flow-control queries."""

from pyspark.sql import functions as F

from ..operators import flow as op
from ..sources.tables import table
from ..sources.views import view, with_views

LIMITS = op.Limits(critical_load=60, max_load=50, max_lag_s=120)
GAP_MS = 6 * 3600 * 1000
BASE_MS, MAX_MS = 100, 64_000

REASON = """CASE WHEN threads_running > 60 THEN 'Critical Load' WHEN threads_running > 50 THEN 'Max Load'
 WHEN lag_s > 120 THEN 'Replication Lag' WHEN query_value > 0 THEN 'Custom Query' WHEN user_flag THEN 'User Command' ELSE 'None' END"""


def metrics(spark, d):
    return view(spark, d, "metrics")


def throttle_decision(spark, d):
    return op.throttle_decision(metrics(spark, d), LIMITS)


THROTTLE_DECISION = with_views("metrics", f"SELECT *, reason <> 'None' AS throttled FROM (SELECT *, {REASON} AS reason FROM metrics)")


def max_lag(spark, d):
    return op.max_lag(metrics(spark, d))


def throttle_periods(spark, d):
    return op.throttle_periods(metrics(spark, d), LIMITS)


_PERIODS = f"""
a AS (SELECT *, reason <> 'None' AS on_ FROM (SELECT *, {REASON} AS reason FROM metrics)),
b AS (SELECT *, on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY replica ORDER BY ts, tick), FALSE) AS st FROM a),
c AS (SELECT *, CAST(sum(CAST(st AS INT)) OVER (PARTITION BY replica ORDER BY ts, tick) AS BIGINT) AS run_no FROM b),
periods AS (SELECT replica, run_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS ticks,
 (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS length_ms, first(reason ORDER BY ts, tick) AS reason
FROM c WHERE on_ GROUP BY replica, run_no)"""
THROTTLE_PERIODS = with_views("metrics", f"WITH {_PERIODS} SELECT * FROM periods")


def throttle_totals(spark, d):
    return op.throttle_totals(throttle_periods(spark, d))


THROTTLE_TOTALS = with_views("metrics", f"""WITH {_PERIODS}
SELECT replica, count(*) AS throttle_count, CAST(sum(length_ms) AS BIGINT) AS total_throttle_ms FROM periods GROUP BY 1""")


def backoff(spark, d):
    return op.backoff(metrics(spark, d), LIMITS, BASE_MS, MAX_MS)


BACKOFF = with_views("metrics", f"""
SELECT replica, tick, ts, attempt, CAST(least({BASE_MS} * pow(2, least(attempt, 40)), {MAX_MS}) AS BIGINT) AS backoff_ms FROM (
 SELECT replica, tick, ts, row_number() OVER (PARTITION BY replica ORDER BY ts, tick) AS attempt
 FROM metrics WHERE {REASON} <> 'None')
""")


def query_throttle(spark, d):
    samples = metrics(spark, d)
    samples.createOrReplaceTempView("metrics")
    return op.query_throttle(spark, "SELECT count(*) FROM metrics WHERE lag_s > 300", samples)


QUERY_THROTTLE = with_views("metrics", """
WITH q AS (SELECT count(*) AS v FROM metrics WHERE lag_s > 300)
SELECT tick, ts, replica, v AS throttle_value, v > 0 AS throttled, CASE WHEN v > 0 THEN 'Custom Query' ELSE 'None' END AS reason FROM metrics, q
""")


def active_sessions(spark, d):
    return op.active_sessions(table(spark, d, "events"), "ts", F.col("event_type") != "view")


def rate_limit(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return op.rate_limit(events, "user_id", "ts", "event_id", GAP_MS)


# event ids rise with time, so the smallest id of a time range is its first event
RATE_LIMIT = f"""
WITH RECURSIVE nxt AS (SELECT event_id, min(event_id) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL {GAP_MS} MILLISECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM events),
kept AS (SELECT min(event_id) AS event_id FROM events GROUP BY user_id
 UNION ALL SELECT n.next_id FROM kept k JOIN nxt n USING (event_id) WHERE n.next_id IS NOT NULL)
SELECT event_id, user_id, ts, event_type FROM events WHERE event_id IN (SELECT event_id FROM kept)
"""

QUERIES = {
    "throttle_decision": (throttle_decision, THROTTLE_DECISION),
    "max_lag": (
        max_lag,
        with_views("metrics", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, max(lag_s) AS max_lag_s, count(*) AS samples FROM metrics GROUP BY 1"),
    ),
    "throttle_periods": (throttle_periods, THROTTLE_PERIODS),
    "throttle_totals": (throttle_totals, THROTTLE_TOTALS),
    "backoff": (backoff, BACKOFF),
    "query_throttle": (query_throttle, QUERY_THROTTLE),
    "active_sessions": (
        active_sessions,
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS active FROM events WHERE event_type <> 'view' GROUP BY 1",
    ),
    "rate_limit": (rate_limit, RATE_LIMIT),
}
