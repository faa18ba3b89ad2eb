"""Ordered per-key work that survives hot keys.

A window partitioned by key puts all rows of a key into one task. Where a key
holds more rows than a task should, the rows are dealt to range partitions of
key and order and written; a partition is a segment. Each (key, segment) is
handled on its own and what earlier segments contribute is carried in from a
small summary of the keys that stand at a partition's border. Borders are taken
from the rows themselves, so a burst, or a key whose rows share one time, is cut
like any other. Without hot keys the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import numbering, staging

SEG = "_seg"
HOT = "_hot"
#: Rows of one key that a single task may order.
MAX_GROUP_ROWS = 2_000_000
#: Segments hold a part of that on average, as borders come from a sample.
SPARE = 2
#: Most segments; beyond it they grow.
MAX_SEGMENTS = 200_000


@dataclass
class Segmented:
    """A DataFrame with a segment column, and how to order within it."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    def local(self) -> WindowSpec:
        """Rows of one key and segment in order."""
        keys = self.group() if self.split else self.keys
        return W.partitionBy(*keys).orderBy(*self.order)

    def group(self) -> list[str]:
        return [*self.keys, SEG]

    def carry(
        self,
        summary: dict[str, Column],
        incoming: dict[str, Callable[[WindowSpec], Column]],
    ) -> Segmented:
        """Add columns computed from all earlier segments of the same key.

        ``summary`` are aggregates per segment; ``incoming`` turn them into
        one value over the window of earlier segments.
        """
        if not self.split:
            # Typed NULLs: one aggregate schema lookup, no job.
            parts = self.df.groupBy(*self.group()).agg(
                *[c.alias(n) for n, c in summary.items()]
            )
            w = _earlier(self.keys)
            typed = parts.select(*[f(w).alias(n) for n, f in incoming.items()]).schema
            df = self.df.select(
                "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in typed]
            )
            return Segmented(df, self.keys, self.order, False)
        parts = (
            self.df.where(HOT)
            .groupBy(*self.group())
            .agg(*[c.alias(n) for n, c in summary.items()])
        )
        w = _earlier(self.keys)
        carried = parts.select(
            *[F.col(k).alias(f"_c_{k}") for k in self.keys],
            F.col(SEG).alias("_c_seg"),
            *[f(w).alias(n) for n, f in incoming.items()],
        )
        match = reduce(
            lambda a, b: a & b,
            [self.df[k].eqNullSafe(carried[f"_c_{k}"]) for k in self.keys],
            self.df[SEG] == carried["_c_seg"],
        )
        # two rows for each segment at most
        df = self.df.join(F.broadcast(carried), match, "left").drop(*[f"_c_{k}" for k in self.keys], "_c_seg")
        return Segmented(df, self.keys, self.order, True)

    def done(self, *drop: str) -> DataFrame:
        return self.df.drop(SEG, HOT, *drop)


def _earlier(keys: list[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)


def segment(
    df: DataFrame, keys: list[str], order: list[str], max_group_rows: int = MAX_GROUP_ROWS,
) -> Segmented:
    """Cut the rows into segments if a key holds more than a task should order.

    Without ``keys`` the whole table is one group. Finding the hot keys costs one
    map-side combined count. Rows that agree in ``order`` may be cut anywhere, so
    that no segment depends on how many of them there are.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) <= max_group_rows:
        plain = df.select("*", F.lit(0).cast("bigint").alias(SEG), F.lit(False).alias(HOT))
        return Segmented(plain, keys, order, False)
    n = max(numbering.range_partitions(df), min(MAX_SEGMENTS, -(-total * SPARE // max_group_rows)))
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if _holds_map(df.schema[c].dataType) else F.col(c) for c in df.columns])
    ranged = df.repartitionByRange(n, *keys, *order, tie)
    fixed = staging.stage(ranged.withColumn(SEG, F.spark_partition_id().cast("bigint")), "segments")
    if not keys:
        return Segmented(fixed.withColumn(HOT, F.lit(True)), keys, order, True)
    # only keys at a border can go on in another segment
    key = F.struct(*keys)
    borders = fixed.groupBy(F.col(SEG).alias("_b_seg")).agg(F.min(key).alias("_b_lo"), F.max(key).alias("_b_hi"))
    at_border = key.eqNullSafe(F.col("_b_lo")) | key.eqNullSafe(F.col("_b_hi"))
    marked = fixed.join(F.broadcast(borders), fixed[SEG] == borders["_b_seg"]).withColumn(HOT, at_border)
    return Segmented(marked.drop("_b_seg", "_b_lo", "_b_hi"), keys, order, True)


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def last_before(seg: Segmented, value: Column, name: str, inclusive: bool = False) -> Segmented:
    """Last non-NULL ``value`` before each row (or up to it) in key order."""
    frame = seg.local().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    tail = F.max_by(value, F.when(value.isNotNull(), F.struct(*seg.order)))
    out = seg.carry(
        {"_tail": tail},
        {"_carried": lambda w: F.last("_tail", ignorenulls=True).over(w)},
    )
    local = F.last(value, ignorenulls=True).over(frame)
    df = out.df.withColumn(name, F.coalesce(local, F.col("_carried"))).drop("_carried")
    return Segmented(df, seg.keys, seg.order, seg.split)


def running_sum(seg: Segmented, value: Column, name: str) -> Segmented:
    """Running total of a bigint ``value`` in key order, the row included."""
    frame = seg.local().rowsBetween(W.unboundedPreceding, 0)
    out = seg.carry(
        {"_part": F.sum(value)},
        {"_carried": lambda w: F.sum("_part").over(w)},
    )
    total = F.coalesce(F.sum(value).over(frame), F.lit(0)) + F.coalesce(F.col("_carried"), F.lit(0))
    df = out.df.withColumn(name, total.cast("bigint")).drop("_carried")
    return Segmented(df, seg.keys, seg.order, seg.split)
