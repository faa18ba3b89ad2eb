"""Hint log queries."""

from pyspark.sql import functions as F

from ..operators import hints as op
from ..plans.staging import new_path
from ..sources import sinks
from ..sources.tables import table
from ..sources.views import view, with_views

MAX_GAP_MS = 6 * 3600 * 1000


def hints(spark, d):
    return view(spark, d, "hints")


def append_hints(spark, d):
    """Heartbeats first, then all other hints, as two appends."""
    path = new_path(spark, "hints")
    rows = hints(spark, d).withColumnRenamed("id", "event_id")
    beat = F.col("hint") == "heartbeat"
    sinks.append_hints(rows.where(beat), path, ["event_id"], exists=False)
    sinks.append_hints(rows.where(~beat), path, ["event_id"], exists=True)
    return sinks.read_hints(spark, path, "id bigint, job bigint, hint string, value string, ts timestamp_ntz")


APPEND_HINTS = with_views("hints", """
SELECT row_number() OVER (ORDER BY hint <> 'heartbeat', id) AS id, job, hint, value, ts FROM hints
""")


def latest_hints(spark, d):
    return op.latest_hints(hints(spark, d))


LATEST_HINTS = with_views("hints", """
SELECT job, hint, id, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY job, hint ORDER BY id DESC) AS rn FROM hints) WHERE rn = 1
""")


def latest_state(spark, d):
    return op.latest_state(hints(spark, d))


LATEST_STATE = with_views("hints", """
SELECT job, id, hint, value, ts, hint = 'completed' AS complete, hint IN ('cancelled', 'panic-abort') AS cancelled,
 CASE WHEN contains(value, ':') THEN split_part(value, ':', 1) END AS log_file,
 CASE WHEN contains(value, ':') THEN TRY_CAST(split_part(value, ':', 2) AS BIGINT) END AS log_pos
FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY id DESC) AS rn FROM hints) WHERE rn = 1
""")


def classify_hints(spark, d):
    return op.classify_hints(hints(spark, d))


CLASSIFY_HINTS = with_views("hints", """
SELECT CASE WHEN hint = 'good-to-go' THEN 'heartbeat' ELSE hint END AS kind, count(*) AS "rows",
 count(*) FILTER (WHERE hint = 'good-to-go') AS unknown_rows FROM hints GROUP BY 1
""")


def resume_point(spark, d):
    return op.resume_point(hints(spark, d), view(spark, d, "change_log"), 1)


RESUME_POINT = with_views("change_log hints", """
WITH s AS (SELECT *, CAST(substr(file, 8) AS BIGINT) AS seq FROM change_log),
p AS (SELECT CAST(substr(split_part(value, ':', 1), 8) AS BIGINT) AS q, CAST(split_part(value, ':', 2) AS BIGINT) AS o
      FROM hints WHERE job = 1 AND contains(value, ':')),
m AS (SELECT q AS resume_seq, o AS resume_pos FROM p ORDER BY q DESC, o DESC LIMIT 1)
SELECT * FROM s, m WHERE seq > resume_seq OR (seq = resume_seq AND pos > resume_pos)
""")


def heartbeat_gaps(spark, d):
    return op.heartbeat_gaps(hints(spark, d), MAX_GAP_MS)


HEARTBEAT_GAPS = with_views("hints", f"""
SELECT *, coalesce(gap_ms > {MAX_GAP_MS}, FALSE) AS late FROM (
 SELECT *, (epoch_us(ts) - epoch_us(previous_ts)) // 1000 AS gap_ms FROM (
  SELECT job, id, ts, lag(ts) OVER (PARTITION BY job ORDER BY id) AS previous_ts FROM hints WHERE hint = 'heartbeat'))
""")


def heartbeat_lag(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return op.heartbeat_lag(events, hints(spark, d), "user_id", "ts", ["event_id"])


HEARTBEAT_LAG = with_views("hints", """
SELECT e.event_id, e.user_id, e.event_type, e.ts, h.ts AS heartbeat_ts, (epoch_us(e.ts) - epoch_us(h.ts)) // 1000 AS lag_ms
FROM events e ASOF LEFT JOIN (SELECT job, ts FROM hints WHERE hint = 'heartbeat') h ON e.user_id = h.job AND e.ts >= h.ts
""")

QUERIES = {
    "append_hints": (append_hints, APPEND_HINTS),
    "latest_hints": (latest_hints, LATEST_HINTS),
    "latest_state": (latest_state, LATEST_STATE),
    "classify_hints": (classify_hints, CLASSIFY_HINTS),
    "resume_point": (resume_point, RESUME_POINT),
    "heartbeat_gaps": (heartbeat_gaps, HEARTBEAT_GAPS),
    "heartbeat_lag": (heartbeat_lag, HEARTBEAT_LAG),
}
