"""State of a stream as a few tables that combine in any order.

Each micro-batch adds a part. When there are more than MOST_PARTS, the newest
ones are merged with as many older ones as are not larger than all that came
after them, so parts shrink from old to new, a row is merged a number of times
that grows with the logarithm of the batches, and a read opens few parts however
many batches there were. A part is named by the batches it covers; it counts once
it is whole, and one that lies in a larger one no longer counts. So a batch that
is run again, or a merge that broke off, changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans import staging

#: Parts that a read opens at most.
MOST_PARTS = 16
_NAME = re.compile(r"batches=(\d+)-(\d+)$")


class Parts:
    """Rows under ``path``; ``combine`` makes the same state of parts in any order and number."""

    def __init__(self, spark: SparkSession, path: str, schema, combine: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.combine = spark, path.rstrip("/"), schema, combine

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store what a batch gives; nothing if that is already there."""
        if self.holds(batch_id):
            return
        rows.write.mode("overwrite").parquet(self._folder((batch_id, batch_id)))
        if len(self.ranges()) > MOST_PARTS:
            self._merge()

    def holds(self, batch_id: int) -> bool:
        """Whether the batch is stored already."""
        return any(a <= batch_id <= b for a, b in self._whole())

    def read(self) -> DataFrame:
        """All parts; ``combine`` makes one state of them."""
        return self._read(self.ranges())

    def ranges(self) -> list[tuple[int, int]]:
        """The parts that count, old to new, as first and last batch."""
        whole = self._whole()
        return [r for r in whole if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in whole)]

    def _folder(self, part: tuple[int, int]) -> str:
        return f"{self.path}/batches={part[0]}-{part[1]}"

    def _whole(self) -> list[tuple[int, int]]:
        found = (_NAME.search(f) for f in staging.folders(self.spark, self.path) if staging.exists(self.spark, f"{f}/_SUCCESS"))
        return sorted((int(m[1]), int(m[2])) for m in found if m)

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._folder, parts))

    def _merge(self) -> None:
        whole, parts = self._whole(), self.ranges()
        size = [staging.size(self.spark, self._folder(p)) for p in parts]
        first = next((i for i in range(len(parts) - 1) if size[i] <= sum(size[i + 1 :])), len(parts) - 2)
        # what earlier merges replaced goes now; readers have had many batches to leave it
        for old in set(whole) - set(parts):
            staging.drop_path(self.spark, self._folder(old))
        merged = (parts[first][0], parts[-1][1])
        self.combine(self._read(parts[first:])).write.mode("overwrite").parquet(self._folder(merged))
