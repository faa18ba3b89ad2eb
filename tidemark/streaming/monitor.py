"""Event counts, throttling, heartbeats, rate limits and duplicates on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import flow
from ..operators.hints import HEARTBEAT
from ..plans import skew
from . import runner
from .ordered import LABEL, ORDER, TOLD, US, Step, in_time_order


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``_time``, as watermarks need a timestamp with time zone."""
    return events.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)


def stream_event_counts(
    events: DataFrame, ts: str, kind: str, width: str, delay: str, out_path: str, checkpoint: str
) -> DataFrame:
    """Events per kind and interval, each interval once it is closed.

    Rows later than ``delay`` are dropped when their interval is closed. A
    finite input closes them all by its end marker (``runner.close_folder``).
    """
    runner.use_rocksdb(events.sparkSession)
    counts = (
        _timed(events, ts, delay).where(F.col("_time") < runner.END)
        .groupBy(F.window("_time", width), kind)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            kind,
            "events",
        )
    )
    schema = counts.schema
    runner.run_available(
        counts.writeStream.outputMode("append").format("parquet").option("path", out_path), checkpoint
    )
    return events.sparkSession.read.schema(schema).parquet(out_path)


def stream_dedupe(events: DataFrame, key: list[str], ts: str, delay: str, out_path: str, checkpoint: str) -> DataFrame:
    """Drop an event seen before within the watermark."""
    runner.use_rocksdb(events.sparkSession)
    kept = _timed(events, ts, delay).dropDuplicatesWithinWatermark(key).drop("_time")
    runner.run_available(
        kept.writeStream.outputMode("append").format("parquet").option("path", out_path), checkpoint
    )
    return events.sparkSession.read.schema(events.schema).parquet(out_path)


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _carried(key: str, us: Column, label: Column | None = None, told: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """What a key carries on, told from output rows."""
    label, told = (F.lit("") if label is None else label), (F.lit(False) if told is None else told)
    return lambda out: out.select(key, us.alias(US), label.alias(LABEL), told.alias(TOLD))


def _reason_changes(rows: DataFrame, carried: DataFrame, passed: int) -> DataFrame:
    """The samples whose reason differs from the one before, or from NONE at the first."""
    new = rows.select("replica", "tick", "ts", US, ORDER, LABEL, F.lit(True).alias("_new"))
    both = new.unionByName(carried.select("replica", US, LABEL, F.lit(False).alias("_new")), allowMissingColumns=True)
    seg = skew.last_before(skew.segment(both, ["replica"], [US, ORDER, LABEL]), F.col(LABEL), "previous_reason")
    changes = seg.done().withColumn("previous_reason", F.coalesce("previous_reason", F.lit(flow.NONE)))
    return changes.where(F.col("_new") & (F.col(LABEL) != F.col("previous_reason"))).select(
        "replica", "tick", "ts", "previous_reason", F.col(LABEL).alias("reason"))


def stream_throttle(metrics: DataFrame, limits: flow.Limits, delay: str, out_path: str, checkpoint: str) -> DataFrame:
    """Throttle decisions on a stream of samples; only changes of state come out, in order of time."""
    return in_time_order(
        metrics, "replica", "ts", "tick", delay, _reason_changes, _carried("replica", _us("ts"), F.col("reason")),
        out_path, checkpoint, flow.throttle_reason(limits))


def _beats(max_ms: int) -> Step:
    """Gaps between beats, and one row of silence as soon as a gap is too long."""
    wait = (max_ms + 1) * 1000  # the first moment a gap is too long
    at = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")

    def step(rows: DataFrame, carried: DataFrame, passed: int) -> DataFrame:
        new = rows.select("job", "id", US, ORDER, F.lit(False).alias(TOLD), F.lit(True).alias("_new"))
        both = new.unionByName(carried.select("job", US, TOLD, F.lit(False).alias("_new")), allowMissingColumns=True)
        seg = skew.last_before(skew.segment(both, ["job"], [US, ORDER, "id"]), F.struct(US, TOLD), "_before")
        beats = seg.done().where("_new").select("job", "id", US, F.col(f"_before.{US}").alias("_last"), F.col(f"_before.{TOLD}").alias("_was_told"))
        ended = beats.where(~F.col("_was_told") & (F.col(US) >= F.col("_last") + wait)).select("job", F.col("_last").alias(US))
        newest = both.groupBy("job").agg(F.max(F.struct(US, TOLD)).alias("_r")).select("job", "_r.*")
        lasting = newest.where(~F.col(TOLD) & (F.col(US) + wait < passed)).select("job", US)
        silent = ended.union(lasting).select("job", (F.col(US) + wait).alias(US), F.col(US).alias("_last"), F.lit(True).alias("silent"))
        all_ = beats.drop("_was_told").withColumn("silent", F.lit(False)).unionByName(silent, allowMissingColumns=True)
        gap = F.floor((F.col(US) - F.col("_last")) / 1000).cast("bigint")
        found = all_.select("job", "id", at(F.col(US)).alias("ts"), at(F.col("_last")).alias("previous_ts"), gap.alias("gap_ms"), "silent")
        return found.withColumn("late", F.coalesce(F.col("gap_ms") > max_ms, F.lit(False)))

    return step


def stream_heartbeat_monitor(hints: DataFrame, max_ms: int, delay: str, out_path: str, checkpoint: str) -> DataFrame:
    """Gaps between the heartbeats of each job in order of time, and silences.

    A silence is a row without an id, at the first moment when the gap since the
    last beat is too long. It comes out with the watermark, without a later beat.
    """
    told = _carried("job", F.when(F.col("silent"), _us("previous_ts")).otherwise(_us("ts")), told=F.col("silent"))
    return in_time_order(hints, "job", "ts", "id", delay, _beats(max_ms), told, out_path, checkpoint, only=F.col("hint") == HEARTBEAT)


def stream_rate_limit(
    events: DataFrame, key: str, ts: str, order: str, ms: int, delay: str, out_path: str, checkpoint: str
) -> DataFrame:
    """Rate limit per key in order of time, with the last kept row of each key carried on."""

    def spaced(rows: DataFrame, carried: DataFrame, passed: int) -> DataFrame:
        new = rows.select(*events.columns, F.lit(True).alias("_new"))
        at = F.timestamp_micros(US).cast(events.schema[ts].dataType)
        kept_before = carried.select(key, at.alias(ts), F.lit(False).alias("_new"))
        both = new.unionByName(kept_before, allowMissingColumns=True)
        return flow.rate_limit(both, key, ts, order, ms).where("_new").select(*events.columns)

    return in_time_order(events, key, ts, order, delay, spaced, _carried(key, _us(ts)), out_path, checkpoint)
