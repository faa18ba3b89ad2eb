"""Per-key work on streams in order of event time, whatever order the rows arrive in.

Rows are held in tables until the watermark has passed them. Each micro-batch
then takes the rows that its watermark has newly passed, together with the one
row that each key carries over from those before, as one batch job. So the result
depends on the rows alone, not on how they were dealt to files and batches, as
long as no row is later than the delay.

A row is written once and read when it is due. What belongs to a batch is named
by its number and the batch's mark is written last, so a batch that is run again
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import staging
from . import runner
from .state import Parts

#: Time in microseconds of a held row, what its order is at equal times, and its label.
US, ORDER, LABEL = "_us", "_order", "_label"
#: Whether a silence after the carried row was told.
TOLD = "_told"
#: The held rows that are due, what the keys carry, the watermark in microseconds; gives output rows.
Step = Callable[[DataFrame, DataFrame, int], DataFrame]

_MARK = "top long, held long, last long"


class InTimeOrder:
    """Handles the micro-batches of one stream; ``state`` is a folder of its own."""

    def __init__(
        self, events: DataFrame, key: str, ts: str, order: str, delay: str, step: Step, carry: Callable[[DataFrame], DataFrame],
        out_path: str, state: str, label: Column | None = None, only: Column | None = None,
    ):
        self.spark, self.out_path, self.state = events.sparkSession, out_path.rstrip("/"), state.rstrip("/")
        self.key, self.delay, self.step, self.carry = key, delay, step, carry
        self.time = F.col(ts).cast("timestamp")
        wanted = F.col(key).isNotNull() & (self.time < runner.END)
        self.wanted = wanted if only is None else wanted & only
        self.held = lambda df: df.select(
            *df.columns, F.unix_micros(self.time).alias(US), F.col(order).cast("long").alias(ORDER),
            (F.lit("") if label is None else label).alias(LABEL))
        empty = self.spark.createDataFrame([], events.schema)
        self.schema = self.held(empty).schema
        carried = f"`{key}` {dict(events.dtypes)[key]}, {US} long, {LABEL} string, {TOLD} boolean"
        self.carried = Parts(self.spark, f"{self.state}/carry", carried, self._last)

    def handle(self, batch: DataFrame, number: int) -> None:
        """Hold the rows of a batch and emit all that are due after it."""
        marks = self._marks()
        if number in marks:
            return
        before, live = self._mark(max(marks)) if marks else (None, {})
        watermark = F.unix_micros(F.max(self.time) - F.expr(f"INTERVAL {self.delay}"))
        in_time = self.wanted if before is None else self.wanted & (F.unix_micros(self.time) >= before)
        passed, last = batch.agg(watermark, F.max(F.when(in_time, F.unix_micros(self.time)))).first()
        passed = max((w for w in (before, passed) if w is not None), default=None)
        if last is not None:
            # in order of time, so that a read skips what is not due
            self.held(batch.where(in_time)).sortWithinPartitions(US).write.mode("overwrite").parquet(self._held(number))
            live[number] = last
        if passed is not None and passed != before and not self.carried.holds(number):
            self._emit(live, before, passed, number)
        left = {n: at for n, at in live.items() if passed is None or at >= passed}
        self._write_mark(number, passed, left)
        for n in self._numbers("held") - set(left):
            staging.drop_path(self.spark, self._held(n))

    def _emit(self, live: dict[int, int], before: int | None, passed: int, number: int) -> None:
        due = self.spark.createDataFrame([], self.schema)
        if live:
            due = self.spark.read.schema(self.schema).parquet(*map(self._held, sorted(live))).where(F.col(US) < passed)
        if before is not None:
            due = due.where(F.col(US) >= before)
        out = self.step(due, self._last(self.carried.read()), passed)
        path = f"{self.out_path}/{number}"
        out.write.mode("overwrite").parquet(path)
        self.carried.add(self._last(self.carry(self.spark.read.schema(out.schema).parquet(path))), number)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last row of each key, as carried; a silence that was told is told."""
        newest = F.max(F.struct(US, TOLD, LABEL))
        return rows.groupBy(self.key).agg(newest.alias("_r")).select(self.key, f"_r.{US}", f"_r.{LABEL}", f"_r.{TOLD}")

    def _mark(self, number: int) -> tuple[int | None, dict[int, int]]:
        """The watermark after a batch, and the batches with rows held, with their last times."""
        rows = self.spark.read.schema(_MARK).parquet(f"{self.state}/marks/{number}").collect()
        return rows[0].top, {r.held: r.last for r in rows if r.held is not None}

    def _write_mark(self, number: int, passed: int | None, live: dict[int, int]) -> None:
        rows = [(passed, n, at) for n, at in live.items()] or [(passed, None, None)]
        self.spark.createDataFrame(rows, _MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/marks/{number}")

    def _marks(self) -> set[int]:
        return {n for n in self._numbers("marks") if staging.exists(self.spark, f"{self.state}/marks/{n}/_SUCCESS")}

    def _numbers(self, kind: str) -> set[int]:
        return {int(f.rsplit("/", 1)[1]) for f in staging.folders(self.spark, f"{self.state}/{kind}")}

    def _held(self, number: int) -> str:
        return f"{self.state}/held/{number}"


def in_time_order(
    events: DataFrame, key: str, ts: str, order: str, delay: str, step: Step, carry: Callable[[DataFrame], DataFrame],
    out_path: str, checkpoint: str, label: Column | None = None, only: Column | None = None,
) -> DataFrame:
    """All rows that ``step`` gave for a stream, once its input is done.

    ``step`` gets the columns of ``events`` with US, ORDER and LABEL, and (key,
    US, LABEL, TOLD) of what each key carries, whose times lie before those of
    the rows. ``carry`` derives the latter from output rows. Rows without a time
    or key, rows that are not ``only`` and rows that come after the watermark of
    the batch before has passed them stay out. The state is kept with the checkpoint.
    """
    spark = events.sparkSession
    job = InTimeOrder(events, key, ts, order, delay, step, carry, out_path, f"{checkpoint}/in-time-order", label, only)
    runner.for_each_batch(events, job.handle, checkpoint)
    schema = step(spark.createDataFrame([], job.schema), job.carried.read().limit(0), 0).schema
    if not staging.exists(spark, out_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out_path)
