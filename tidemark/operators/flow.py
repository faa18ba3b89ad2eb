"""Flow control: throttle decisions, lag, backoff, rate limits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import skew, staging

# Names of the reasons to slow down.
NONE, LAG, LOAD, CRITICAL = "None", "Replication Lag", "Max Load", "Critical Load"
USER, CUSTOM = "User Command", "Custom Query"


@dataclass(frozen=True)
class Limits:
    """Limits of the load samples; None or, for the lag, 0 turns one off."""

    critical_load: int | None = None
    max_load: int | None = None
    max_lag_s: int = 60
    use_query: bool = True


def throttle_reason(limits: Limits) -> Column:
    """First condition that holds for a load sample, else ``None`` as text."""
    threads = F.col("threads_running")
    tests: list[tuple[Column, str]] = []
    if limits.critical_load:
        tests.append((threads > limits.critical_load, CRITICAL))
    if limits.max_load:
        tests.append((threads > limits.max_load, LOAD))
    if limits.max_lag_s > 0:
        tests.append((F.col("lag_s") > limits.max_lag_s, LAG))
    if limits.use_query:
        tests.append((F.col("query_value") > 0, CUSTOM))
    tests.append((F.col("user_flag"), USER))
    out = F.lit(NONE)
    for test, reason in reversed(tests):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return out


def throttle_decision(metrics: DataFrame, limits: Limits) -> DataFrame:
    out = metrics.withColumn("reason", throttle_reason(limits))
    return out.withColumn("throttled", F.col("reason") != NONE)


def max_lag(metrics: DataFrame, width: str = "1 hour") -> DataFrame:
    """Worst lag over all replicas per interval."""
    return (
        metrics.groupBy(F.window("ts", width))
        .agg(F.max("lag_s").alias("max_lag_s"), F.count(F.lit(1)).alias("samples"))
        .select(F.col("window.start").alias("window_start"), "max_lag_s", "samples")
    )


def _throttled(metrics: DataFrame, limits: Limits, max_group_rows: int) -> skew.Segmented:
    marked = throttle_decision(metrics, limits)
    return skew.segment(marked, ["replica"], ["ts", "tick"], max_group_rows)


def throttle_periods(metrics: DataFrame, limits: Limits, max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Runs of throttled ticks per replica with the reason at their start.

    Few replicas hold all ticks, so long replicas are cut into segments and a
    run may span several of them.
    """
    seg = _throttled(metrics, limits, max_group_rows)
    seg = skew.last_before(seg, F.col("throttled"), "_was")
    starts = F.col("throttled") & ~F.coalesce(F.col("_was"), F.lit(False))
    seg = skew.Segmented(seg.df.withColumn("_start", starts.cast("bigint")), seg.keys, seg.order, seg.split)
    seg = skew.running_sum(seg, F.col("_start"), "run_no")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        seg.done().where("throttled")
        .groupBy("replica", "run_no")
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count(F.lit(1)).alias("ticks"),
            F.floor((F.max(us) - F.min(us)) / 1000).cast("bigint").alias("length_ms"),
            F.min_by("reason", F.struct("ts", "tick")).alias("reason"),
        )
    )


def throttle_totals(periods: DataFrame) -> DataFrame:
    """Number of throttle periods and time spent in them, per replica."""
    return periods.groupBy("replica").agg(
        F.count(F.lit(1)).alias("throttle_count"), F.sum("length_ms").alias("total_throttle_ms")
    )


def backoff(
    metrics: DataFrame, limits: Limits, base_ms: int, max_ms: int, max_group_rows: int = skew.MAX_GROUP_ROWS
) -> DataFrame:
    """Wait before the next try: the base doubled per throttle so far, at most ``max_ms``."""
    seg = _throttled(metrics, limits, max_group_rows)
    seg = skew.Segmented(seg.df.where("throttled"), seg.keys, seg.order, seg.split)
    seg = skew.running_sum(seg, F.lit(1), "attempt")
    # beyond 2**40 the limit holds for sure
    doubled = F.lit(base_ms).cast("bigint") * F.pow(F.lit(2.0), F.least(F.col("attempt"), F.lit(40)))
    wait = F.least(doubled, F.lit(float(max_ms))).cast("bigint")
    return seg.done().select("replica", "tick", "ts", "attempt", wait.alias("backoff_ms"))


def query_throttle(spark: SparkSession, sql: str, metrics: DataFrame) -> DataFrame:
    """A user query decides: throttle when its one value is a whole number above 0."""
    row = spark.sql(sql).first()
    value = None if row is None or row[0] is None else str(row[0]).strip()
    number = int(value) if value and value.isascii() and value.lstrip("+").isdigit() else None
    on = number is not None and number > 0
    return metrics.select(
        "tick", "ts", "replica",
        F.lit(number).cast("bigint").alias("throttle_value"),
        F.lit(on).alias("throttled"),
        F.lit(CUSTOM if on else NONE).alias("reason"),
    )


def active_sessions(events: DataFrame, ts: str, active: Column, width: str = "1 hour") -> DataFrame:
    """Sessions that are not sleeping, per interval."""
    return (
        events.where(active).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("active"))
        .select(F.col("window.start").alias("window_start"), "active")
    )


# --- rate limit -------------------------------------------------------------
#
# Keep a row only if enough time has passed since the last row kept. Within a
# key this is a chain. A hot key is cut into segments: each one first says, for
# every time the chain may enter it, when the chain leaves it. An exit points to
# the entry it leads to, in a later segment. Doubling these pointers finds the
# entries that the chain takes in a few joins; then all segments mark their rows.

FAR = -(2**62)  # before any time
_NEVER = 2**62  # after any time


def _jumps(us: np.ndarray, gap: int) -> np.ndarray:
    """For each row the first row at least ``gap`` later."""
    return np.searchsorted(us, us + gap, side="left")


def exit_table(us: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function from entry time to the time the chain is free again.

    For entry times up to ``limit[i]`` (and above the limit before) the chain
    leaves at ``leave[i]``. Entry can only be less than ``gap`` after the
    first row or at that row, later rows are never the first kept.
    """
    n = len(us)
    jump = _jumps(us, gap)
    leave = us + gap
    for i in range(n - 1, -1, -1):
        if jump[i] < n:
            leave[i] = leave[jump[i]]
    entries = int(np.searchsorted(us, us[0] + gap, side="left")) + 1
    limit, leave = us[:entries], leave[:entries]
    last = np.append(leave[1:] != leave[:-1], True)
    return limit[last], leave[last]


def kept_rows(us: np.ndarray, starts: np.ndarray, free_at: list[int], gap: int) -> tuple[np.ndarray, int]:
    """Mark the kept rows of several groups of sorted times.

    ``starts`` are the group offsets, ``free_at`` the first time allowed in
    each. Also returns when the last group is free again.
    """
    keep = np.zeros(len(us), dtype=bool)
    ends = np.append(starts[1:], len(us))
    free = FAR
    for begin, end, free in zip(starts.tolist(), ends.tolist(), free_at):
        part = us[begin:end]
        i = int(np.searchsorted(part, free, side="left"))
        if i == end - begin:
            continue
        jump = _jumps(part, gap).tolist()
        size = end - begin
        while i < size:
            keep[begin + i] = True
            free = int(part[i]) + gap
            i = jump[i]
    return keep, free


def rate_limit(
    df: DataFrame, key: str, ts: str, order: str, ms: int, max_group_rows: int = skew.MAX_GROUP_ROWS,
) -> DataFrame:
    """Keep a row only if at least ``ms`` have passed since the last kept row of its key.

    The first row of a key is kept; rows with equal times are taken by
    ``order``, rows without a time are left out. Without a gap all others stay.
    Tasks pass over their sorted rows batch by batch and hold no group in memory.
    """
    gap = ms * 1000
    base = df.where(F.col(ts).isNotNull())
    if gap <= 0:
        return base
    base = base.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    seg = skew.segment(base, [key], ["_us", order], max_group_rows)
    entered = _with_entry(seg, key, gap, max_group_rows) if seg.split else seg.df.withColumn("_free", F.lit(FAR))
    names = df.columns
    grouped = [key, skew.SEG]
    ready = (
        entered.select(*names, skew.SEG, "_us", "_free")
        .repartition(*(grouped if seg.split else grouped[:1]))
        .sortWithinPartitions(*grouped, "_us", order)
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, open_free = None, FAR
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys, segs = batch.column(key), batch.column(skew.SEG)
            runs = pc.run_end_encode(keys).run_ends.to_numpy(zero_copy_only=False)[:-1]
            seg_values = segs.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(seg_values[1:] != seg_values[:-1]) + 1
            starts = np.unique(np.concatenate(([0], runs, cuts))).astype(np.int64)
            us = batch.column("_us").to_numpy(zero_copy_only=False)
            free = batch.column("_free").to_numpy(zero_copy_only=False)[starts].tolist()
            first = (keys[0].as_py(), int(seg_values[0]))
            if first == open_group:
                free[0] = open_free
            keep, open_free = kept_rows(us, starts, free, gap)
            open_group = (keys[n - 1].as_py(), int(seg_values[-1]))
            yield batch.select(names).filter(pa.array(keep))

    return ready.mapInArrow(mark, df.schema)


def _with_entry(seg: skew.Segmented, key: str, gap: int, max_group_rows: int) -> DataFrame:
    """Add ``_free``, when the chain of a hot key may enter the segment; never where it passes a segment by."""
    key_type = seg.df.schema[key].dataType
    steps_schema = T.StructType([
        T.StructField("k", key_type), *(T.StructField(c, T.LongType()) for c in ("s", "t", "leave")),
    ])

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        limit, leave = exit_table(np.sort(group["_us"].to_numpy(np.int64)), gap)
        return pd.DataFrame({"k": [group[key].iloc[0]] * len(limit), "s": int(group[skew.SEG].iloc[0]), "t": limit, "leave": leave})

    # an entry is (key, segment, latest time of entering)
    entries = staging.stage(
        seg.df.where(skew.HOT).select(key, skew.SEG, "_us").groupBy(key, skew.SEG).applyInPandas(steps, steps_schema), "entries")
    links = staging.stage(_links(entries, max_group_rows), "links")
    begin = links.where("s = -1").select("k", "to_s", "to_t")
    taken = _taken(begin, links.where("s >= 0").select("k", "s", "t", "to_s", "to_t"))
    on_chain = links.alias("a").join(
        taken.alias("b"), F.expr("a.k <=> b.k AND a.s = b.s AND a.t = b.t"), "left_semi"
    ).union(links.where("s = -1"))
    # one entry of a segment at most is taken
    entry = F.broadcast(on_chain.select(F.col("k").alias("_k"), F.col("to_s").alias("_s"), F.col("free").alias("_free")))
    match = seg.df[key].eqNullSafe(entry["_k"]) & (seg.df[skew.SEG] == entry["_s"])
    free = F.when(F.col(skew.HOT), F.coalesce("_free", F.lit(_NEVER))).otherwise(F.lit(FAR))
    return seg.df.join(entry, match, "left").drop("_k", "_s").withColumn("_free", free)


def _links(entries: DataFrame, max_group_rows: int) -> DataFrame:
    """(k, s, t, to_s, to_t, free): the first entry at or after the time each entry's chain is free.

    The chain of a key begins at entry (-1, -1). Entries and exits are merged in
    falling order of time, and an exit takes the last entry before it.
    """
    begin = entries.select("k").distinct().select(
        "k", F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("t"), F.lit(FAR).alias("at"))
    exits = entries.select("k", "s", "t", F.col("leave").alias("at")).union(begin).select(
        "*", F.lit(1).alias("_side"), F.lit(None).cast("struct<s:bigint,t:bigint>").alias("_to"))
    targets = entries.select(
        "k", "s", "t", F.col("t").alias("at"), F.lit(0).alias("_side"), F.struct("s", "t").alias("_to"))
    both = exits.union(targets).withColumns({"_falling": -F.col("at"), "_last": -F.col("s")})
    merged = skew.segment(both, ["k"], ["_falling", "_side", "_last"], max_group_rows)
    found = skew.last_before(merged, F.col("_to"), "_next").done().where("_side = 1 AND _next IS NOT NULL")
    return found.select("k", "s", "t", F.col("_next.s").alias("to_s"), F.col("_next.t").alias("to_t"), F.col("at").alias("free"))


def _taken(begin: DataFrame, jumps: DataFrame) -> DataFrame:
    """The entries reached from ``begin``: after n rounds those up to 2**n links away.

    A chain enters a segment once, so there are about log2(segments) rounds.
    """
    taken = begin.toDF("k", "s", "t")
    while True:
        more = taken.alias("a").join(jumps.alias("b"), F.expr("a.k <=> b.k AND a.s = b.s AND a.t = b.t")).select("b.k", "b.to_s", "b.to_t")
        more = staging.stage(more.toDF("k", "s", "t"), "taken")
        if more.isEmpty():
            return taken
        taken = taken.union(more)
        twice = jumps.alias("a").join(jumps.alias("b"), F.expr("a.k <=> b.k AND a.to_s = b.s AND a.to_t = b.t"))
        jumps = staging.stage(twice.select("a.k", "a.s", "a.t", "b.to_s", "b.to_t"), "jumps")
