"""The paths for hot keys and large inputs give the same rows as the plain ones."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.catalog import alter as c_alter, changelog as c_log, copy as c_copy, flow as c_flow, hints as c_hints
from tidemark.catalog import columns as c_cols
from tidemark.operators import alter, changelog, columns, copy, flow, hints, verify
from tidemark.plans import sizes, skew
from tidemark.sources.tables import table

D = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def con():
    return connect(D)


def test_heartbeat_gaps(spark, con):
    assert compare(hints.heartbeat_gaps(c_hints.hints(spark, D), c_hints.MAX_GAP_MS, 10), con, c_hints.HEARTBEAT_GAPS) == []


def test_heartbeat_lag(spark, con):
    events = table(spark, D, "events").select("event_id", "user_id", "event_type", "ts")
    got = hints.heartbeat_lag(events, c_hints.hints(spark, D), "user_id", "ts", ["event_id"], 10)
    assert compare(got, con, c_hints.HEARTBEAT_LAG) == []


def test_throttle_periods_and_backoff(spark, con):
    samples = c_flow.metrics(spark, D)
    assert compare(flow.throttle_periods(samples, c_flow.LIMITS, 20), con, c_flow.THROTTLE_PERIODS) == []
    assert compare(flow.backoff(samples, c_flow.LIMITS, 100, 64_000, 20), con, c_flow.BACKOFF) == []


def test_copy_progress(spark, con):
    got = copy.copy_progress(c_copy.chunk_log(spark, D), "job", ["ts", "event_id"], "ts", "chunk_rows", 10)
    assert compare(got, con, c_copy.COPY_PROGRESS) == []


def test_duration_text(spark, con):
    events = table(spark, D, "events").select("event_id", "user_id", "ts")
    assert compare(columns.duration_text(events, "user_id", "ts", "event_id", 10), con, c_cols.DURATION_TEXT) == []


def test_rate_limit(spark, con):
    events = table(spark, D, "events").select("event_id", "user_id", "ts", "event_type")
    assert compare(flow.rate_limit(events, "user_id", "ts", "event_id", c_flow.GAP_MS, 20), con, c_flow.RATE_LIMIT) == []


def test_current_file_with_many_rotations(spark, con):
    assert compare(changelog.current_file(c_log.log(spark, D), 2, 50), con, c_log.CURRENT_FILE) == []


def test_assign_chunks_by_merge(spark, con):
    bounds = copy.chunk_boundaries(table(spark, D, "orders"), "o_orderkey", 10, one_task=False)
    got = copy.assign_chunks(table(spark, D, "lineitem"), bounds, "l_orderkey", max_lookup=20)
    got = got.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "chunk_id")
    assert compare(got, con, c_copy.ASSIGN_CHUNKS.replace("/ 1000)", "/ 10)")) == []


def test_assign_chunks_with_one_hot_key_and_large_keys(spark):
    big = 2**60
    df = spark.range(2000).select((F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")) + big).alias("k"))
    bounds = copy.chunk_boundaries(df, "k", 100)
    got = copy.assign_chunks(df, bounds, "k", 4).groupBy("chunk_id").count()
    want = bounds.select("chunk_id", F.col("rows").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunks_by_keys_of_any_kind(spark):
    """Two columns, text, dates and numbers past doubles; few and many rows in a task; nulls in no chunk."""
    df = spark.range(600).select(
        (F.col("id") % 7).alias("a"), F.concat(F.lit("k"), F.col("id") % 90).alias("b"), F.col("id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("d"),
        F.when(F.col("id") % 50 != 0, F.col("id") % 97 + 2**60).alias("n"))
    for key in (["a", "b"], ["b"], ["d"], ["n"], ["n", "a"]):
        rows = sorted((tuple(r[k] for k in key) for r in df.collect() if None not in [r[k] for k in key]))
        first, want = {}, {}
        for i, k in enumerate(rows):
            first.setdefault(k, i)
        want = {k: i // 50 for k, i in first.items()}
        for one_task in (True, False):
            bounds = copy.chunk_boundaries(df, key if len(key) > 1 else key[0], 50, one_task)
            for limit in (2_000_000, 40):
                got = copy.assign_chunks(df, bounds, key, 5, limit).collect()
                assert len(got) == 600
                assert all(r.chunk_id == want.get(tuple(r[k] for k in key)) for r in got)
    sums = verify.chunk_checksums(df, df.where("id <> 77"), copy.chunk_boundaries(df, ["a", "b"], 50), ["a", "b"], ["id"]).where("differs").collect()
    assert len(sums) == 1 and sums[0].left_rows == sums[0].right_rows + 1


def test_numbering_over_partitions(spark, con):
    lines = table(spark, D, "lineitem")
    got = alter.add_auto_increment(lines, c_alter._LINE_ORDER, "line_id", one_task=False)
    assert compare(got, con, c_alter.ADD_AUTO_INCREMENT) == []
    bounds = copy.chunk_boundaries(lines, "l_orderkey", 100, one_task=False)
    assert compare(bounds, con, c_copy._bounds("lineitem", "l_orderkey", 100)) == []


def test_apply_changes_by_full_join(spark, con):
    got = changelog.apply_changes(c_log.snapshot(spark, D), c_log.rows(spark, D), c_log.KEY, broadcast=False, before_key=c_log.KEY_BEFORE)
    assert compare(got, con, c_log.APPLY_CHANGES) == []


def test_one_key_with_a_third_of_the_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id",
        F.timestamp_micros(F.col("id") * 1000).cast("timestamp_ntz").alias("ts"),
    )
    seg = skew.segment(df, ["k"], ["id"], 100)
    assert seg.split
    sizes = seg.df.groupBy(skew.SEG).count()
    assert sizes.agg(F.max("count")).first()[0] <= 200 and sizes.count() >= 30
    assert seg.df.where(F.col(skew.HOT) & (F.col("k") == 0)).count() == 1000
    total = skew.running_sum(seg, F.lit(1), "n").done()
    hot = total.where("k = 0").orderBy("id").select("n").collect()
    assert [r.n for r in hot] == list(range(1, 1001))
    assert total.where("k <> 0 AND n <> 1").count() == 0


def test_null_key_can_be_hot(spark):
    df = spark.range(500).select(F.lit(None).cast("string").alias("k"), "id")
    seg = skew.segment(df, ["k"], ["id"], 50)
    got = skew.last_before(seg, F.col("id"), "p").done().orderBy("id").collect()
    assert seg.split and [r.p for r in got] == [None, *range(499)]


def test_a_burst_is_cut_by_rows(spark):
    """99 % of a key at one time: no segment above twice the limit, and the same sums and predecessors."""
    df = spark.range(2000).select(
        F.lit("a").alias("k"), F.when(F.col("id") < 1980, F.lit(7)).otherwise(F.col("id")).alias("t"), "id")
    seg = skew.segment(df, ["k"], ["t", "id"], 100)
    assert seg.df.groupBy(skew.SEG).count().agg(F.max("count")).first()[0] <= 200
    got = skew.running_sum(seg, F.col("id"), "sum").done().orderBy("id").collect()
    assert [r["sum"] for r in got] == [i * (i + 1) // 2 for i in range(2000)]
    # rows that agree in the whole order are cut as well
    same = skew.segment(df.select("k", F.lit(1).alias("t"), "id"), ["k"], ["t"], 100)
    assert same.df.groupBy(skew.SEG).count().agg(F.max("count")).first()[0] <= 200
    assert sorted(r.n for r in skew.running_sum(same, F.lit(1), "n").done().collect()) == list(range(1, 2001))
    whole = skew.segment(df, [], ["t", "id"], 100)
    assert [r.p for r in skew.last_before(whole, F.col("id"), "p").done().orderBy("id").collect()] == [None, *range(1999)]


@pytest.mark.parametrize("gap_ms, limit", [(1, 20), (40, 20), (700, 15), (100_000, 30)])
def test_rate_limit_of_a_hot_key_equals_a_replay(spark, gap_ms, limit):
    """Gaps shorter than a segment, and longer than every segment; a burst in between; null keys."""
    rng = np.random.default_rng(gap_ms)
    times = np.concatenate([np.sort(rng.integers(0, 60_000, 500)), np.full(120, 30_000), [200_000]])
    rows = [("h", int(t), i) for i, t in enumerate(times)] + [(None, int(t), 1000 + i) for i, t in enumerate(times[:90])] + [("c", 5, 5000), ("c", 6, 5001)]
    df = spark.createDataFrame(rows, "k string, ms long, id long").select(
        "k", "id", "ms", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"))
    got = flow.rate_limit(df, "k", "ts", "id", gap_ms, limit).collect()
    for key in ("h", None, "c"):
        own = sorted((ms, i) for k, ms, i in rows if k == key)
        kept, free = [], None
        for ms, i in own:
            if free is None or ms >= free:
                kept.append(i)
                free = ms + gap_ms
        assert sorted(r.id for r in got if r.k == key) == sorted(kept)


def test_no_gap_keeps_all(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, T0)], "k string, id int, ts timestamp_ntz")
    assert [r.id for r in flow.rate_limit(df, "k", "ts", "id", 0).collect()] == [2]


def test_many_rotations_equal_the_inline_form(spark):
    """Rotations at every third position; long positions and file numbers need no clamp."""
    rows = spark.range(3000).select(
        F.concat(F.lit("b."), (2**33 + F.floor(F.col("id") / 100)).cast("string")).alias("file"),
        (2**40 + F.col("id") % 100 * 10).alias("pos"), F.when(F.col("id") % 3 == 0, changelog.ROTATE).otherwise(changelog.INSERT).alias("event_type"))
    few = rows.where("pos < 1099511627800 OR event_type <> 'Rotate'")
    for log in (few, rows.limit(300)):
        inline = changelog.current_file(log, 10_000)
        carried = changelog.current_file(log, 2, 50)
        assert sorted(map(str, inline.collect())) == sorted(map(str, carried.collect()))


def _replay(us, gap):
    kept, free = [], None
    for t in us:
        if free is None or t >= free:
            kept.append(t)
            free = t + gap
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_exit_table_matches_replay(seed):
    rng = np.random.default_rng(seed)
    us = np.sort(rng.integers(0, 2000, 400)).astype(np.int64)
    gap = int(rng.integers(1, 300))
    limit, leave = flow.exit_table(us, gap)
    for free in range(int(us[0]) - 5, int(us[0]) + gap):
        keep, out = flow.kept_rows(us, np.array([0]), [free], gap)
        i = int(np.searchsorted(limit, free))
        assert (int(leave[i]) if i < len(limit) else free) == out
    assert us[flow.kept_rows(us, np.array([0]), [-1], gap)[0]].tolist() == _replay(us.tolist(), gap)


def test_planned_size_is_known(spark):
    lines = table(spark, D, "lineitem")
    assert 0 < sizes.planned_bytes(lines.select("l_orderkey")) < sizes.planned_bytes(lines) < sizes.SMALL_INPUT_BYTES
    assert not skew.segment(lines, ["l_orderkey"], ["l_linenumber"]).split
    assert sizes.bounded_rows(lines, 10) is None
    assert len(sizes.bounded_rows(table(spark, D, "region"), 10)) == 5
