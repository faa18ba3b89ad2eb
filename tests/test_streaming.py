"""Streams: any split of a log, repeated batches, late rows, state between batches."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog as op, flow
from tidemark.sources.logs import read_change_log, write_change_log
from tidemark.catalog import changelog as c_log, streams as c_streams
from tidemark.streaming import apply, monitor, ordered, runner, state
from tidemark.streaming.status import StatusListener

LOG = "file string, pos bigint, event_type string, k bigint, v string"
T0 = datetime(2024, 1, 1)


def folder(spark, path, schema, *parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return runner.read_folder(spark, str(path), schema, files_per_trigger=1)


def test_any_split_of_the_log_gives_the_same_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    rows, snap = c_log.rows(spark, d), c_log.snapshot(spark, d)
    want = sorted(map(str, op.apply_changes(snap, rows, c_log.KEY, before_key=c_log.KEY_BEFORE).collect()))
    for n in (1, 5):
        path = str(tmp_path / f"log{n}")
        rows.repartition(n).write.parquet(path)  # events of a key in any file order
        stream = runner.read_folder(spark, path, rows.schema, files_per_trigger=2)
        got = apply.stream_apply(
            stream, snap, c_log.KEY, str(tmp_path / f"s{n}"), str(tmp_path / f"c{n}"), before_key=c_log.KEY_BEFORE)
        assert sorted(map(str, got.collect())) == want


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    events = [("b.1", 4, op.UPDATE, 1, "x"), ("b.1", 9, op.DELETE, 2, None)]
    log = spark.createDataFrame(events, LOG)
    once = op.compact_changes(log, "k", ["v"])
    twice = op.combine_compacted(once.union(once), "k")
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    assert op.apply_compacted(snap, twice, "k").collect() == op.apply_compacted(snap, once, "k").collect()


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    snap = spark.createDataFrame([(1, "a")], "k bigint, v string")
    seen = []
    for part in ([("b.1", 4, op.UPDATE, 1, "x")], [("b.1", 9, op.INSERT, 2, "y")]):
        stream = folder(spark, tmp_path / "log", LOG, part)
        got = apply.stream_apply(
            stream, snap, "k", str(tmp_path / "state"), str(tmp_path / "cp"),
            on_batch=lambda b, i: seen.append((i, b.count())),
        )
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y")]
    assert seen == [(0, 1), (1, 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    stream = folder(
        spark, tmp_path / "in", "ts timestamp_ntz, kind string",
        # lateness is judged by the watermark of the batch before
        [(at(0.5), "a"), (at(9.5), "a")], [(at(9.6), "a")], [(at(0.6), "a"), (at(20), "a")],
    )
    got = monitor.stream_event_counts(stream, "ts", "kind", "1 hour", "2 hours", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.window_start, r.events) for r in got.collect()) == [(at(0), 1), (at(9), 2)]


BEATS = "job bigint, id bigint, hint string, ts timestamp_ntz"


def test_beats_and_silence(spark, tmp_path):
    """A silence comes with the watermark, not with the next beat; at the end of the input every job is silent."""
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [[(1, 1, "heartbeat", at(0)), (2, 7, "heartbeat", at(1))], [(1, 2, "other", at(60))], [(1, 3, "heartbeat", at(5)), (None, 9, "heartbeat", at(5))]]
    run = lambda: sorted(
        (r.job, (r.ts - T0).total_seconds(), r.id, r.gap_ms, r.late, r.silent)
        for r in monitor.stream_heartbeat_monitor(stream, 1000, "10 minutes", str(tmp_path / "o"), str(tmp_path / "c")).collect())
    stream = folder(spark, tmp_path / "in", BEATS, *parts)
    assert run() == []  # all may still be late
    stream = folder(spark, tmp_path / "in", BEATS, [(3, 4, "other", at(602.5))])
    assert run() == [(1, 0.0, 1, None, False, False), (1, 1.001, None, 1001, True, True), (2, 1.0, 7, None, False, False), (2, 2.001, None, 1001, True, True)]
    runner.close_folder(spark, str(tmp_path / "in"), BEATS, "ts")
    stream = runner.read_folder(spark, str(tmp_path / "in"), BEATS, 1)
    assert run() == [
        (1, 0.0, 1, None, False, False), (1, 1.001, None, 1001, True, True), (1, 5.0, 3, 5000, True, False), (1, 6.001, None, 1001, True, True),
        (2, 1.0, 7, None, False, False), (2, 2.001, None, 1001, True, True)]


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_rate_limit_with_files_in_any_order(spark, tmp_path, seed):
    times = [T0 + timedelta(milliseconds=m) for m in (0, 40, 110, 150, 209, 211, 300, 420, 421, 600)]
    rows = [(1, i, t, f"x{i}") for i, t in enumerate(times)]
    schema = "k bigint, id bigint, ts timestamp_ntz, v string"
    want = sorted(map(tuple, flow.rate_limit(spark.createDataFrame(rows, schema), "k", "ts", "id", 100, 3).collect()))
    assert [r[1] for r in want] == [0, 2, 5, 7, 9]
    if seed is not None:
        random.Random(seed).shuffle(rows)
    folder(spark, tmp_path / "in", schema, rows[:4], rows[4:7], rows[7:])
    runner.close_folder(spark, str(tmp_path / "in"), schema, "ts")
    stream = runner.read_folder(spark, str(tmp_path / "in"), schema, 1)
    got = monitor.stream_rate_limit(stream, "k", "ts", "id", 100, "1 minute", str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == want


def test_throttle_changes_with_files_in_any_order(spark, tmp_path):
    schema = "tick bigint, ts timestamp_ntz, replica string, lag_s bigint, threads_running bigint, query_value int, user_flag boolean"
    lags = [0, 0, 500, 600, 0, 0, 700, 0]
    rows = [(i, T0 + timedelta(seconds=i // 2), "r", lag, 1, 0, False) for i, lag in enumerate(lags)]
    folder(spark, tmp_path / "in", schema, rows[5:], rows[:2], rows[2:5])
    runner.close_folder(spark, str(tmp_path / "in"), schema, "ts")
    stream = runner.read_folder(spark, str(tmp_path / "in"), schema, 1)
    got = monitor.stream_throttle(stream, flow.Limits(), "1 minute", str(tmp_path / "o"), str(tmp_path / "c"))
    assert [(r.tick, r.previous_reason, r.reason) for r in got.orderBy("tick").collect()] == [
        (2, flow.NONE, flow.LAG), (4, flow.LAG, flow.NONE), (6, flow.NONE, flow.LAG), (7, flow.LAG, flow.NONE)]


def test_log_reader_skips_earlier_files(spark, tmp_path):
    path = str(tmp_path / "log")
    write_change_log(c_log.log(spark, "/root/testdata/sf0.001"), path)
    got = read_change_log(spark, path, ("binlog.12", 1))
    assert all("seq=1" in f and int(f.split("seq=")[1].split("/")[0]) >= 12 for f in _files_read(got))
    for bad in (("", 5), ("binlog.9", 0)):
        with pytest.raises(ValueError):
            read_change_log(spark, path, bad)


def _files_read(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_events_can_be_rewritten_and_watched(spark, tmp_path):
    seen = []
    listener = StatusListener(lambda kind, text: seen.append(kind))
    spark.streams.addListener(listener)
    try:
        stream = folder(spark, tmp_path / "log", LOG, [("b.1", 4, op.INSERT, 2, "y")])
        snap = spark.createDataFrame([(1, "a")], "k bigint, v string")

        def shout(batch):
            return batch.mapInPandas(lambda frames: (f.assign(v=f.v.str.upper()) for f in frames), batch.schema)

        got = apply.stream_apply(stream, snap, "k", str(tmp_path / "s"), str(tmp_path / "c"), rewrite=shout)
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "Y")]
    finally:
        time.sleep(2)
        spark.streams.removeListener(listener)
    assert "progress" in seen


def test_many_batches_stay_few_parts(spark, tmp_path, monkeypatch):
    """After 120 batches, some run again and one merge broken off, a read opens few parts and misses nothing."""
    monkeypatch.setattr(state, "MOST_PARTS", 5)
    parts = state.Parts(spark, str(tmp_path / "parts"), "k bigint, n bigint", lambda rows: rows.groupBy("k").agg(F.max("n").alias("n")))
    assert parts.read().count() == 0
    merges, merge = [], parts._merge
    monkeypatch.setattr(parts, "_merge", lambda: (merges.append(parts.ranges()), merge()))
    for i in range(120):
        rows = spark.range(1).select(F.lit(i % 50).cast("long").alias("k"), F.lit(i).cast("long").alias("n"))
        parts.add(rows, i)
        if i % 11 == 0:
            parts.add(rows.limit(0), i)  # run again, with nothing left to read
        if i == 60:  # a merge that was cut off before it was whole
            (tmp_path / "parts" / "batches=0-60").mkdir(exist_ok=True)
            (tmp_path / "parts" / "batches=0-60" / "part-x.parquet").write_bytes(b"")
        assert len(parts.ranges()) <= 6
    ranges = parts.ranges()
    assert ranges[0][0] == 0 and ranges[-1][1] == 119 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))
    got = parts.combine(parts.read()).collect()
    assert sorted((r.k, r.n) for r in got) == sorted((k, max(i for i in range(120) if i % 50 == k)) for k in range(50))
    rewritten = sum(m[-1][1] - m[0][0] + 1 for m in merges)
    assert len(merges) < 60 and rewritten < 120 * 30


def test_ordered_work_is_batch_jobs_and_can_break_off(spark, tmp_path, monkeypatch):
    """Rate limits, throttling and heartbeats call no Python per key, hold only what is not due, and run a batch again."""
    rows = [(k, 10 * i + k, "heartbeat", T0 + timedelta(seconds=40 * i + k)) for k in range(3) for i in range(20)]
    random.Random(3).shuffle(rows)
    rows.sort(key=lambda r: r[3] >= T0 + timedelta(seconds=400))
    folder(spark, tmp_path / "in", BEATS, *(rows[i : i + 10] for i in range(0, 60, 10)))
    runner.close_folder(spark, str(tmp_path / "in"), BEATS, "ts")
    write, broken = ordered.InTimeOrder._write_mark, []

    def breaks_off(job, number, passed, left):
        if number in (4, 6) and number not in broken:
            broken.append(number)
            raise RuntimeError("lost")
        write(job, number, passed, left)

    monkeypatch.setattr(ordered.InTimeOrder, "_write_mark", breaks_off)
    before = {q.id for q in spark.streams.active}
    for _ in range(3):
        stream = runner.read_folder(spark, str(tmp_path / "in"), BEATS, 1)
        try:
            got = monitor.stream_heartbeat_monitor(stream, 30_000, "450 seconds", str(tmp_path / "o"), str(tmp_path / "c")).collect()
        except Exception as e:
            assert "lost" in str(e)
    assert broken == [4, 6] and {q.id for q in spark.streams.active} == before
    beats = sorted((r.job, r.id, r.gap_ms) for r in got if not r.silent)
    assert beats == sorted((k, 10 * i + k, 40_000 if i else None) for k in range(3) for i in range(20))
    assert sorted((r.job, r.previous_ts) for r in got if r.silent) == sorted((r[0], r[3]) for r in rows)
    assert not (tmp_path / "c" / "state").exists()  # no state store, hence no call per key and batch
    assert not list((tmp_path / "c" / "in-time-order" / "held").glob("*"))


def test_rate_limit_takes_no_python_call_per_key(spark, tmp_path):
    """20,000 keys in three batches."""
    keys = spark.range(60_000).selectExpr("id % 20000 k", "id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, floor(id / 20000) * 60) ts")
    for i in range(3):
        keys.where(f"id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    runner.close_folder(spark, str(tmp_path / "in"), keys.schema, "ts")
    stream = runner.read_folder(spark, str(tmp_path / "in"), keys.schema, 1)
    got = monitor.stream_rate_limit(stream, "k", "ts", "id", 100_000, "1 hour", str(tmp_path / "o"), str(tmp_path / "c"))
    assert got.where("id < 20000").count() == 20_000 and got.where("id >= 40000").count() == 20_000 and got.count() == 40_000
    assert not (tmp_path / "c" / "state").exists()


def test_batches_do_not_grow_with_the_files(spark, tmp_path):
    """The streamed duplicates of a table in 120 files come in 15, those of four files in four."""
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).cast("timestamp_ntz")
    for files, batches in ((30, 15), (1, 4)):
        df = spark.range(0, 40_000, 1, files).select("id", F.concat(F.lit("g"), "id").alias("gtid"), ts.alias("ts"))
        df = df.union(df).repartition(files, F.col("id") % 97)
        cp = tmp_path / f"c{files}"
        got = monitor.stream_dedupe(c_streams._stream(spark, df, "gtids"), ["gtid"], "ts", c_streams._DELAY, str(tmp_path / f"o{files}"), str(cp))
        assert got.count() == 40_000 and got.select("gtid").distinct().count() == 40_000
        # at the end of the input one batch without rows may follow
        assert batches <= len([f for f in (cp / "commits").iterdir() if f.name.isdigit()]) <= batches + 2
