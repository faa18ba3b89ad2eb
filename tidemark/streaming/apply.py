"""Change logs as streams: replay into a table, last change per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changelog
from ..operators.inspect import Key, key_columns
from . import runner
from .state import Parts


def stream_apply(
    log: DataFrame, snapshot: DataFrame, key: Key, state_path: str, checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    rewrite: Callable[[DataFrame], DataFrame] | None = None,
    before_key: Key | None = None,
) -> DataFrame:
    """Replay a streamed change log over a snapshot.

    Each micro-batch is compacted to one row per key, with the log positions
    it stands for, and stored as a part of the state (``state.Parts``), of which
    there are never many. Compacted rows combine in any order and any number of times, so a batch run again, files out of
    order or a key split over batches change nothing. ``on_batch`` gets each
    micro-batch before it is stored; ``rewrite`` may change the events, for
    example to apply an ALTER to them or to map them in pandas. With
    ``before_key`` updates may change the key.
    """
    cols = [c for c in snapshot.columns if c not in key_columns(key)]

    def handle(batch: DataFrame, batch_id: int) -> None:
        if on_batch is not None:
            on_batch(batch, batch_id)
        events = batch if rewrite is None else rewrite(batch)
        parts.add(changelog.compact_changes(events, key, cols, before_key), batch_id)

    sample = _static(log)
    schema = changelog.compact_changes(sample if rewrite is None else rewrite(sample), key, cols, before_key).schema
    parts = Parts(snapshot.sparkSession, state_path, schema, lambda rows: changelog.combine_compacted(rows, key))
    runner.for_each_batch(log, handle, checkpoint)
    return changelog.apply_compacted(snapshot, changelog.combine_compacted(parts.read(), key), key)


def _static(stream: DataFrame) -> DataFrame:
    """An empty batch table with the columns of a stream."""
    return stream.sparkSession.createDataFrame([], stream.schema)


def stream_latest(log: DataFrame, key: Key, out_path: str, checkpoint: str) -> DataFrame:
    """Running last change per key.

    The state store holds the last change; every batch emits the keys it
    moved. A key emitted by several batches is settled by its log position.
    """
    runner.use_rocksdb(log.sparkSession)
    keys = key_columns(key)
    events = changelog.with_sequence(log).dropna(subset=keys)
    value = [c for c in events.columns if c not in keys]
    running = (
        events.groupBy(*keys)
        .agg(F.max_by(F.struct(*value), F.struct("seq", "pos")).alias("_r"))
        .select(*keys, "_r.*")
    )

    def newest(moved: DataFrame) -> DataFrame:
        return changelog.latest_change(moved, key).select(*running.columns)

    parts = Parts(log.sparkSession, out_path, running.schema, newest)
    runner.for_each_batch(running, parts.add, checkpoint, mode="update")
    return newest(parts.read())
