"""Hint log: latest entries, resume points, heartbeats and lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords
from ..plans import skew

# The known hints and the ends a run can have.
HEARTBEAT = "heartbeat"
KNOWN_HINTS = (
    "heartbeat", "shadow-table-migrated", "row-copy-complete", "all-events-up-to-lock-processed",
    "cut-over-phase", "completed", "cancelled", "panic-abort",
)
COMPLETE = ("completed",)
CANCELLED = ("cancelled", "panic-abort")


def latest_hints(hints: DataFrame) -> DataFrame:
    """Last row per job and hint, by id."""
    return (
        hints.groupBy("job", "hint")
        .agg(F.max_by(F.struct("id", "value", "ts"), "id").alias("_r"))
        .select("job", "hint", "_r.*")
    )


def latest_state(hints: DataFrame) -> DataFrame:
    """Last row per job, whether the run ended, and the position it recorded."""
    last = hints.groupBy("job").agg(F.max_by(F.struct("id", "hint", "value", "ts"), "id").alias("_r")).select("job", "_r.*")
    return last.select(
        "*",
        F.col("hint").isin(*COMPLETE).alias("complete"),
        F.col("hint").isin(*CANCELLED).alias("cancelled"),
        coords.position_file(F.col("value")).alias("log_file"),
        coords.position_offset(F.col("value")).alias("log_pos"),
    )


def classify_hints(hints: DataFrame) -> DataFrame:
    """Rows per kind; an unknown hint counts as a heartbeat."""
    known = F.col("hint").isin(*KNOWN_HINTS)
    return (
        hints.groupBy(F.when(known, F.col("hint")).otherwise(F.lit(HEARTBEAT)).alias("kind"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(~known).alias("unknown_rows"))
    )


def resume_point(hints: DataFrame, log: DataFrame, job) -> DataFrame:
    """Events after the highest position recorded for a job.

    The position is one small aggregate; as literals it prunes the log. With
    no position on record the log is replayed from its start.
    """
    at = F.struct(
        coords.file_sequence(coords.position_file(F.col("value"))).alias("seq"),
        coords.position_offset(F.col("value")).alias("pos"),
    )
    recorded = hints.where(F.col("job") == job).where(coords.position_offset(F.col("value")).isNotNull())
    top = recorded.agg(F.max(at).alias("at")).first()["at"]
    events = log if "seq" in log.columns else log.withColumn("seq", coords.file_sequence(F.col("file")))
    if top is not None:
        events = events.where(coords.after(F.col("seq"), F.col("pos"), top["seq"], top["pos"]))
    return events.withColumn("resume_seq", F.lit(top and top["seq"]).cast("bigint")).withColumn(
        "resume_pos", F.lit(top and top["pos"]).cast("bigint")
    )


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def heartbeat_gaps(hints: DataFrame, max_ms: int, max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Time from one heartbeat of a job to the next, and whether it is too long."""
    beats = hints.where(F.col("hint") == HEARTBEAT).select("job", "id", "ts")
    # ids rise with time
    seg = skew.segment(beats, ["job"], ["id"], max_group_rows)
    seg = skew.last_before(seg, F.col("ts"), "previous_ts")
    gap = F.floor((_us(F.col("ts")) - _us(F.col("previous_ts"))) / 1000).cast("bigint")
    return seg.done().withColumn("gap_ms", gap).withColumn("late", F.coalesce(F.col("gap_ms") > max_ms, F.lit(False)))


def heartbeat_lag(
    events: DataFrame, hints: DataFrame, key: str, ts: str, order: Sequence[str],
    max_group_rows: int = skew.MAX_GROUP_ROWS,
) -> DataFrame:
    """Age of the newest heartbeat of the job at each event.

    Events and heartbeats are merged and ordered per job, so this is one
    shuffle and no inequality join. A heartbeat at the time of an event counts.
    """
    left = events.select(
        F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
        F.lit(None).cast("timestamp_ntz").alias("_beat"), F.struct(*events.columns).alias("_row"),
    )
    right = hints.where(F.col("hint") == HEARTBEAT).select(
        F.col("job").alias("_key"), F.col("ts").alias("_ts"), F.lit(0).alias("_side"),
        F.col("ts").alias("_beat"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
    )
    both = left.unionByName(right)
    seg = skew.segment(both, ["_key"], ["_ts", "_side"], max_group_rows)
    seg = skew.last_before(seg, F.col("_beat"), "heartbeat_ts", inclusive=True)
    age = F.floor((_us(F.col("_ts")) - _us(F.col("heartbeat_ts"))) / 1000).cast("bigint")
    return seg.done().where("_side = 1").select("_row.*", "heartbeat_ts", age.alias("lag_ms"))
