"""Key range, chunk and copy queries."""

from pyspark.sql import functions as F

from ..operators import copy as op
from ..operators.alter import DropColumn, column_pairs
from ..plans.staging import new_path
from ..sources.tables import table

_LAST = 1000
_CHUNK = 1000


def scan_key_range(spark, d):
    return op.scan_key_range(table(spark, d, "orders"), "o_orderkey", 1000, 9000, 5000)


def next_key(spark, d):
    return op.next_key(table(spark, d, "orders"), "o_orderkey", _LAST)


def chunk_boundaries(spark, d):
    orders = op.chunk_boundaries(table(spark, d, "orders"), "o_orderkey", _CHUNK)
    lines = op.chunk_boundaries(table(spark, d, "lineitem"), "l_orderkey", _CHUNK)
    return orders.withColumn("source", F.lit("orders")).unionByName(
        lines.withColumn("source", F.lit("lineitem"))
    )


def _bounds(table_name, key, n=_CHUNK):
    return f"""
SELECT chunk_id, coalesce(lag(hi) OVER (ORDER BY chunk_id), first_key) AS lo, hi, "rows" FROM (
  SELECT CAST(floor(before / {n}) AS BIGINT) AS chunk_id, min(k) AS first_key, max(k) AS hi, CAST(sum(c) AS BIGINT) AS "rows"
  FROM (SELECT k, c, sum(c) OVER (ORDER BY k) - c AS before
        FROM (SELECT {key} AS k, count(*) AS c FROM {table_name} WHERE {key} IS NOT NULL GROUP BY {key}))
  GROUP BY 1)"""


CHUNK_BOUNDARIES = f"""
SELECT *, 'orders' AS source FROM ({_bounds('orders', 'o_orderkey')})
UNION ALL SELECT *, 'lineitem' AS source FROM ({_bounds('lineitem', 'l_orderkey')})
"""


def _orders_pairs(orders):
    return column_pairs(orders, [DropColumn("o_orderpriority")])


def copy_chunk(spark, d):
    orders = table(spark, d, "orders")
    return op.copy_chunk(orders, _orders_pairs(orders), "o_orderkey", 2000, 3000)


def assign_chunks(spark, d):
    lines = table(spark, d, "lineitem")
    bounds = op.chunk_boundaries(table(spark, d, "orders"), "o_orderkey", _CHUNK)
    placed = op.assign_chunks(lines, bounds, "l_orderkey")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "chunk_id")


ASSIGN_CHUNKS = f"""
WITH b AS ({_bounds('orders', 'o_orderkey')})
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, b.chunk_id FROM lineitem l LEFT JOIN b
ON (l.l_orderkey > b.lo AND l.l_orderkey <= b.hi) OR (b.chunk_id = 0 AND l.l_orderkey = b.lo)
"""


def chunk_turns(spark, d):
    """Chunks of the conversations by a key of two columns, and the chunk of each turn."""
    turns = table(spark, d, "conversations")
    bounds = op.chunk_boundaries(turns, ["conv_id", "turn"], 100)
    placed = op.assign_chunks(turns, bounds, ["conv_id", "turn"])
    return placed.select("conv_id", "turn", "role", "chunk_id")


CHUNK_TURNS = """
SELECT conv_id, turn, role, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN CAST(floor(before / 100) AS BIGINT) END AS chunk_id FROM (
 SELECT c.*, (SELECT count(*) FROM conversations o WHERE (o.conv_id, o.turn) < (c.conv_id, c.turn)) AS before FROM conversations c)
"""


def row_copy(spark, d):
    orders = table(spark, d, "orders")
    path = new_path(spark, "row-copy")
    return op.row_copy(orders, _orders_pairs(orders), path, "o_orderkey")


def copy_missing(spark, d):
    orders = table(spark, d, "orders")
    return op.copy_missing(orders, orders.where("o_orderstatus <> 'P'"), "o_orderkey")


def remaining_rows(spark, d):
    orders = table(spark, d, "orders")
    return op.remaining_rows(orders, orders.where("o_orderstatus <> 'P'"), "o_orderkey")


REMAINING_ROWS = """
SELECT count(*) FILTER (WHERE s.o_orderkey IS NULL) AS remaining, count(*) AS total,
 count(*) FILTER (WHERE s.o_orderkey IS NULL) / CAST(count(*) AS DOUBLE) AS share
FROM orders o LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') s USING (o_orderkey)
"""


def chunk_log(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("job"),
        "event_id",
        "ts",
        F.floor("value").cast("bigint").alias("chunk_rows"),
    )


def copy_progress(spark, d):
    return op.copy_progress(chunk_log(spark, d), "job", ["ts", "event_id"], "ts", "chunk_rows")


COPY_PROGRESS = """
WITH c AS (SELECT user_id AS job, event_id, ts, CAST(floor(value) AS BIGINT) AS chunk_rows FROM events),
s AS (SELECT *, CAST(sum(chunk_rows) OVER (PARTITION BY job ORDER BY ts, event_id) AS BIGINT) AS copied_rows,
 CAST(sum(chunk_rows) OVER (PARTITION BY job) AS BIGINT) AS total_rows,
 (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY job)) / 1000000.0::DOUBLE AS elapsed_s FROM c),
r AS (SELECT *, CASE WHEN elapsed_s > 0 AND copied_rows > 0 THEN copied_rows / elapsed_s ELSE 0.0::DOUBLE END AS rate FROM s)
SELECT job, event_id, ts, chunk_rows, copied_rows, total_rows, total_rows - copied_rows AS remaining_rows,
 CASE WHEN total_rows = 0 THEN 0.0::DOUBLE ELSE CAST(copied_rows AS DOUBLE) / CAST(total_rows AS DOUBLE) * 100 END AS "percent",
 elapsed_s, rate,
 CASE WHEN elapsed_s > 0 AND copied_rows > 0 THEN (total_rows - copied_rows) / rate ELSE 0.0::DOUBLE END AS eta_s FROM r
"""

QUERIES = {
    "scan_key_range": (
        scan_key_range,
        "SELECT * FROM orders WHERE o_orderkey > 1000 AND o_orderkey <= 9000 ORDER BY o_orderkey LIMIT 5000",
    ),
    "next_key": (next_key, f"SELECT o_orderkey AS next_key FROM orders WHERE o_orderkey > {_LAST} ORDER BY 1 LIMIT 1"),
    "chunk_boundaries": (chunk_boundaries, CHUNK_BOUNDARIES),
    "copy_chunk": (
        copy_chunk,
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
        WHERE o_orderkey > 2000 AND o_orderkey <= 3000 ORDER BY o_orderkey""",
    ),
    "chunk_turns": (chunk_turns, CHUNK_TURNS),
    "assign_chunks": (assign_chunks, ASSIGN_CHUNKS),
    "row_copy": (row_copy, "SELECT * EXCLUDE (o_orderpriority) FROM orders"),
    "copy_missing": (copy_missing, "SELECT * FROM orders"),
    "remaining_rows": (remaining_rows, REMAINING_ROWS),
    "copy_progress": (copy_progress, COPY_PROGRESS),
}
