"""Proof that two tables are equal, and what differs if not."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import staging
from .changelog import DELETE, INSERT, UPDATE
from .copy import assign_chunks
from .inspect import Key, key_columns

# Fixed value: what stands for NULL in a hashed row. Other values follow their length.
NULL_MARK = "N"


def row_hash(cols: Sequence[str], fast: bool = False) -> Column:
    """A 64-bit hash of a row; ``fast`` trades MD5 for xxHash.

    Each value follows its length, so no two rows give the same text.
    """
    if fast:
        marks = [F.col(c).isNull() for c in cols]
        return F.xxhash64(*cols, *marks)
    texts = [F.col(c).cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit(NULL_MARK)) for t in texts]
    digest = F.md5(F.concat(*parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def _sums(h: Column) -> list[Column]:
    # Sixteen bits are summed at a time: whole hashes would overflow a bigint,
    # and decimals are slow to add.
    quarters = [F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return [*(F.sum(q).alias(f"_q{i}") for i, q in enumerate(quarters)), F.count(F.lit(1)).alias("rows")]


def _total() -> Column:
    total = F.lit(0).cast("decimal(38,0)")
    for i in range(3, -1, -1):
        quarter = F.coalesce(F.col(f"_q{i}"), F.lit(0)).cast("decimal(20,0)")
        total = (total * F.lit(65536).cast("decimal(5,0)") + quarter).cast("decimal(38,0)")
    return total.cast("string")


def table_checksum(df: DataFrame, cols: Sequence[str] | None = None, fast: bool = False) -> DataFrame:
    """Row count and a checksum that does not depend on row order."""
    hashed = df.select(row_hash(cols or df.columns, fast).alias("_h"))
    return hashed.agg(*_sums(F.col("_h"))).select("rows", _total().alias("checksum"))


def chunk_checksums(
    a: DataFrame, b: DataFrame, boundaries: DataFrame, key: Key, cols: Sequence[str], fast: bool = False
) -> DataFrame:
    """Checksums per chunk on both sides and whether they differ.

    Rows outside all chunks are reported as chunk -1. The chunk list is computed
    once and written.
    """
    boundaries = staging.stage(boundaries.select("chunk_id", "lo", "hi"), "chunks")

    def side(df: DataFrame, tag: str) -> DataFrame:
        placed = assign_chunks(df.select(*dict.fromkeys([*key_columns(key), *cols])), boundaries, key)
        return (
            placed.select(F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), row_hash(cols, fast).alias("_h"))
            .groupBy("chunk_id")
            .agg(*_sums(F.col("_h")))
            .select("chunk_id", F.col("rows").alias(f"{tag}_rows"), _total().alias(f"{tag}_checksum"))
        )

    joined = side(a, "left").join(side(b, "right"), "chunk_id", "full")
    same = F.col("left_checksum").eqNullSafe(F.col("right_checksum")) & F.col("left_rows").eqNullSafe(F.col("right_rows"))
    return joined.withColumn("differs", ~same)


def full_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full join on keys in which NULLs are equal; the keys come once."""
    other = b.select(*[F.col(c).alias(f"_key{i}") if c in keys else F.col(c) for i, c in _numbered(b.columns, keys)])
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)])
    rest = [c for c in [*a.columns, *b.columns] if c not in keys]
    return a.join(other, same, "full").select(*[F.coalesce(c, f"_key{i}").alias(c) for i, c in enumerate(keys)], *rest)


def _numbered(columns: Sequence[str], keys: Sequence[str]) -> list[tuple[int, str]]:
    return [(list(keys).index(c) if c in keys else -1, c) for c in columns]


def compare_tables(a: DataFrame, b: DataFrame, key: Key, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows missing from ``b``, extra in ``b`` or different, and in which columns."""
    keys = key_columns(key)
    left = a.select(*keys, F.lit(True).alias("_l"), *[F.col(x).alias(f"l{i}") for i, (x, _) in enumerate(pairs)])
    right = b.select(*keys, F.lit(True).alias("_r"), *[F.col(y).alias(f"r{i}") for i, (_, y) in enumerate(pairs)])
    joined = full_join(left, right, keys)
    differing = [
        F.when(~F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")), F.lit(y)) for i, (_, y) in enumerate(pairs)
    ]
    unequal = reduce(lambda p, q: p | q, [d.isNotNull() for d in differing], F.lit(False))
    status = (
        F.when(F.col("_r").isNull(), F.lit("missing"))
        .when(F.col("_l").isNull(), F.lit("extra"))
        .when(unequal, F.lit("different"))
    )
    return (
        joined.select(
            *keys,
            status.alias("status"),
            F.when(F.col("_l") & F.col("_r"), F.concat_ws(",", *differing)).alias("columns"),
        )
        .where("status IS NOT NULL")
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: Key, db: str, table: str) -> DataFrame:
    """Change rows that lead from one snapshot to the other.

    They have the form of a change log, one event per key, so applying them
    to ``old`` gives ``new`` back.
    """
    keys = key_columns(key)
    cols = [c for c in old.columns if c not in keys]
    before = old.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"before_{c}") for c in cols])
    after = new.select(*keys, F.lit(True).alias("_a"), *cols)
    unequal = reduce(
        lambda p, q: p | q, [~F.col(f"before_{c}").eqNullSafe(F.col(c)) for c in cols], F.lit(False)
    )
    kind = (
        F.when(F.col("_b").isNull(), F.lit(INSERT))
        .when(F.col("_a").isNull(), F.lit(DELETE))
        .when(unequal, F.lit(UPDATE))
    )
    return (
        full_join(before, after, keys)
        .select(
            F.lit("diff.000001").alias("file"), F.lit(1).cast("bigint").alias("seq"), F.lit(4).cast("bigint").alias("pos"),
            F.lit(db).alias("db"), F.lit(table).alias("tbl"), kind.alias("event_type"),
            *keys, *cols, *[f"before_{c}" for c in cols],
        )
        .where("event_type IS NOT NULL")
    )


def row_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows without a key: what to delete and what to insert, as multisets."""
    gone = old.exceptAll(new).withColumn("event_type", F.lit(DELETE))
    return gone.unionByName(new.exceptAll(old).withColumn("event_type", F.lit(INSERT)))
