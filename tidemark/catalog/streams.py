"""Streaming queries over folders of files written from the test tables."""

from pyspark.sql import functions as F

from ..plans.staging import new_path
from ..sources.logs import CHANGE_LOG_SCHEMA, write_change_log
from ..sources.tables import table
from ..sources.views import with_views
from ..streaming import apply, monitor, runner
from . import changelog, flow, hints
from .changelog import APPLY_CHANGES, KEY, KEY_BEFORE, LATEST_CHANGE

# The events of 30 days arrive in four parts. Rows of a part come in any
# order, so the watermark waits longer than a part lasts.
_CUTS = ["2024-01-08 12:00:00", "2024-01-16 00:00:00", "2024-01-23 12:00:00"]
_DELAY = "8 days"
# A file is a batch, but larger inputs come in more files, not in more batches.
_MOST_BATCHES = 16


def _in_time_order(spark, df, label):
    """Write a table with a time column as parts that follow each other."""
    path = new_path(spark, label)
    cuts = [F.lit(c).cast("timestamp_ntz") for c in _CUTS]
    for i in range(len(cuts) + 1):
        part = df
        if i > 0:
            part = part.where(F.col("ts") >= cuts[i - 1])
        if i < len(cuts):
            part = part.where(F.col("ts") < cuts[i])
        part.write.mode("append").parquet(path)
    return path


def _stream(spark, df, label, files=1):
    return runner.read_folder(spark, _in_time_order(spark, df, label), df.schema, files, most_batches=_MOST_BATCHES)


def _closed_stream(spark, df, label):
    """As ``_stream``, with the end marker that lets the whole input come out."""
    path = _in_time_order(spark, df, label)
    runner.close_folder(spark, path, df.schema, "ts")
    return runner.read_folder(spark, path, df.schema, 1, most_batches=_MOST_BATCHES)


def _log_stream(spark, d):
    path = new_path(spark, "log-stream")
    log = changelog.log(spark, d)
    write_change_log(log.where("tbl = 'orders'"), path)
    stream = runner.read_folder(spark, path, f"{CHANGE_LOG_SCHEMA}, seq bigint", files_per_trigger=8)
    return changelog.op.row_events(stream, "shop", "orders")


def stream_apply(spark, d):
    return apply.stream_apply(
        _log_stream(spark, d), changelog.snapshot(spark, d), KEY, new_path(spark, "compacted"), new_path(spark, "cp"),
        before_key=KEY_BEFORE,
    )


def stream_latest(spark, d):
    return apply.stream_latest(_log_stream(spark, d), KEY, new_path(spark, "latest"), new_path(spark, "cp"))


def stream_event_counts(spark, d):
    events = table(spark, d, "events").select("ts", "event_type")
    return monitor.stream_event_counts(
        _closed_stream(spark, events, "events"), "ts", "event_type", "1 hour", _DELAY, new_path(spark, "counts"), new_path(spark, "cp")
    )


STREAM_EVENT_COUNTS = """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events
FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type FROM events) GROUP BY ALL
"""


def stream_rate_limit(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return monitor.stream_rate_limit(
        _closed_stream(spark, events, "events"), "user_id", "ts", "event_id", flow.GAP_MS, _DELAY,
        new_path(spark, "kept"), new_path(spark, "cp"),
    )


def stream_throttle(spark, d):
    return monitor.stream_throttle(
        _closed_stream(spark, flow.metrics(spark, d), "metrics"), flow.LIMITS, _DELAY, new_path(spark, "changes"), new_path(spark, "cp"),
    )


STREAM_THROTTLE = with_views("metrics", f"""
SELECT * FROM (SELECT replica, tick, ts, coalesce(lag(reason) OVER (PARTITION BY replica ORDER BY ts, tick), 'None') AS previous_reason, reason
 FROM (SELECT *, {flow.REASON} AS reason FROM metrics)) WHERE reason <> previous_reason
""")


def stream_heartbeat_monitor(spark, d):
    return monitor.stream_heartbeat_monitor(
        _closed_stream(spark, hints.hints(spark, d), "hints"), hints.MAX_GAP_MS, _DELAY,
        new_path(spark, "gaps"), new_path(spark, "cp"),
    )


# a job is silent after each beat whose next one is late or missing
STREAM_HEARTBEAT_MONITOR = hints.HEARTBEAT_GAPS.replace("SELECT *, coalesce(gap_ms", f"""
SELECT job, NULL AS id, ts + INTERVAL {hints.MAX_GAP_MS + 1} MILLISECOND AS ts, ts AS previous_ts, {hints.MAX_GAP_MS + 1} AS gap_ms, TRUE AS silent, TRUE AS late
FROM (SELECT job, ts, lead(ts) OVER (PARTITION BY job ORDER BY id) AS next_ts FROM hints WHERE hint = 'heartbeat')
WHERE next_ts IS NULL OR (epoch_us(next_ts) - epoch_us(ts)) // 1000 > {hints.MAX_GAP_MS}
UNION ALL SELECT job, id, ts, previous_ts, gap_ms, FALSE, coalesce(gap_ms""", 1)


def stream_dedupe(spark, d):
    """Every transaction arrives twice."""
    seen = changelog.gtids_with_time(spark, d).select("event_id", "gtid", "ts")
    twice = seen.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
    return monitor.stream_dedupe(
        _stream(spark, twice, "gtids"), ["gtid"], "ts", _DELAY, new_path(spark, "unique"), new_path(spark, "cp")
    )


STREAM_DEDUPE = with_views("gtids", "SELECT g.event_id, g.gtid, e.ts FROM gtids g JOIN events e USING (event_id)")

QUERIES = {
    "stream_apply": (stream_apply, APPLY_CHANGES),
    "stream_latest": (stream_latest, LATEST_CHANGE),
    "stream_event_counts": (stream_event_counts, STREAM_EVENT_COUNTS),
    "stream_rate_limit": (stream_rate_limit, flow.RATE_LIMIT),
    "stream_throttle": (stream_throttle, STREAM_THROTTLE),
    "stream_heartbeat_monitor": (stream_heartbeat_monitor, STREAM_HEARTBEAT_MONITOR),
    "stream_dedupe": (stream_dedupe, STREAM_DEDUPE),
}
