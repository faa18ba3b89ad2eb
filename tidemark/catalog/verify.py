"""Verification, publishing and end-to-end queries."""

import uuid

from pyspark.sql import functions as F

from ..operators import changelog, copy, verify as op
from ..operators.alter import AddColumn, ChangeColumn, ModifyColumn, RenameColumn, alter_table
from ..operators.inspect import KeySpec
from ..plans.migrate import migrate_table as migrate
from ..plans.staging import new_path
from ..sources import sinks
from ..sources.tables import table
from ..sources.views import with_views
from .alter import ALTERED_ORDERS, orders_ops
from .changelog import APPLY_CHANGES, KEY, KEY_BEFORE, rows, snapshot
from .copy import COPY_PROGRESS, _bounds, copy_progress

_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "price_cents"]
_HASH = """CAST('0x' || substr(md5({parts}), 1, 16) AS UBIGINT)"""


def _hash(cols):
    return _HASH.format(parts=" || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in cols))


def progress_json(spark, d):
    done = copy_progress(spark, d).withColumn("percentage", F.round("percent", 4))
    return sinks.progress_json(
        done, ["job", "event_id"],
        {"total_rows": "total_rows", "copied_rows": "copied_rows", "percentage": "percentage", "remaining_rows": "remaining_rows"},
    )


PROGRESS_JSON = f"""
SELECT job, event_id, '{{"total_rows":' || total_rows || ',"copied_rows":' || copied_rows || ',"percentage":' || CAST(round("percent", 4) AS VARCHAR)
 || ',"remaining_rows":' || remaining_rows || '}}' AS payload FROM ({COPY_PROGRESS})
"""


def table_checksum(spark, d):
    return op.table_checksum(table(spark, d, "orders"))


TABLE_CHECKSUM = f"""SELECT count(*) AS "rows", CAST(sum({_hash(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'])}) AS VARCHAR) AS checksum FROM orders"""


def touched(df):
    """The snapshot with its dearest orders repriced."""
    return df.withColumn("price_cents", F.when(F.col("price_cents") > 49_900_000, F.col("price_cents") + 1).otherwise(F.col("price_cents")))


def chunk_checksums(spark, d):
    a = snapshot(spark, d)
    bounds = copy.chunk_boundaries(a, KEY, 500)
    return op.chunk_checksums(a, touched(a), bounds, KEY, _COLS)


CHUNK_CHECKSUMS = with_views("snapshot", f"""
WITH b AS ({_bounds('orders', 'o_orderkey', 500)}),
x AS (SELECT s.*, CASE WHEN price_cents > 49900000 THEN price_cents + 1 ELSE price_cents END AS moved, b.chunk_id
 FROM snapshot s JOIN b ON (s.o_orderkey > b.lo AND s.o_orderkey <= b.hi) OR (b.chunk_id = 0 AND s.o_orderkey = b.lo)),
h AS (SELECT chunk_id, {_hash(_COLS)} AS p, {_hash(['o_orderkey', 'o_custkey', 'o_orderstatus', 'moved'])} AS q FROM x)
SELECT chunk_id, count(*) AS left_rows, CAST(sum(p) AS VARCHAR) AS left_checksum, count(*) AS right_rows,
 CAST(sum(q) AS VARCHAR) AS right_checksum, sum(p) <> sum(q) AS differs FROM h GROUP BY chunk_id
""")


def compare_tables(spark, d):
    a = snapshot(spark, d)
    b = changelog.apply_changes(a, rows(spark, d), KEY, before_key=KEY_BEFORE)
    return op.compare_tables(a, b, KEY, [(c, c) for c in _COLS[1:]])


_AFTER = f"n AS ({APPLY_CHANGES})"
COMPARE_TABLES = with_views("snapshot", f"""
WITH {_AFTER},
j AS (SELECT coalesce(s.o_orderkey, n.o_orderkey) AS o_orderkey,
 CASE WHEN n.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra'
  WHEN s.o_custkey IS DISTINCT FROM n.o_custkey OR s.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR s.price_cents IS DISTINCT FROM n.price_cents THEN 'different' END AS status,
 CASE WHEN s.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN concat_ws(',',
  CASE WHEN s.o_custkey IS DISTINCT FROM n.o_custkey THEN 'o_custkey' END,
  CASE WHEN s.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END,
  CASE WHEN s.price_cents IS DISTINCT FROM n.price_cents THEN 'price_cents' END) END AS columns
 FROM snapshot s FULL JOIN n ON s.o_orderkey = n.o_orderkey)
SELECT * FROM j WHERE status IS NOT NULL
""")


def snapshot_diff(spark, d):
    a = snapshot(spark, d)
    b = changelog.apply_changes(a, rows(spark, d), KEY, before_key=KEY_BEFORE)
    return op.snapshot_diff(a, b, KEY, "shop", "orders")


SNAPSHOT_DIFF = with_views("snapshot", f"""
WITH {_AFTER}
SELECT 'diff.000001' AS file, CAST(1 AS BIGINT) AS seq, CAST(4 AS BIGINT) AS pos, 'shop' AS db, 'orders' AS tbl,
 CASE WHEN s.o_orderkey IS NULL THEN 'WriteRows' WHEN n.o_orderkey IS NULL THEN 'DeleteRows' ELSE 'UpdateRows' END AS event_type,
 coalesce(s.o_orderkey, n.o_orderkey) AS o_orderkey, n.o_custkey, n.o_orderstatus, n.price_cents,
 s.o_custkey AS before_o_custkey, s.o_orderstatus AS before_o_orderstatus, s.price_cents AS before_price_cents
FROM snapshot s FULL JOIN n ON s.o_orderkey = n.o_orderkey
WHERE s.o_orderkey IS NULL OR n.o_orderkey IS NULL OR s.o_custkey IS DISTINCT FROM n.o_custkey
 OR s.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR s.price_cents IS DISTINCT FROM n.price_cents
""")


def _name(label):
    return f"{label}_{uuid.uuid4().hex[:12]}"


def publish(spark, d):
    """Two versions under one name; the second replaces the first."""
    name = _name("orders_published")
    orders = table(spark, d, "orders")
    sinks.publish(orders, name, 1, new_path(spark, name))
    return sinks.publish(alter_table(orders, orders_ops()), name, 2, new_path(spark, name), drop_old=True)


def migration_ops():
    return [
        AddColumn("note", "varchar(64)", default="", nullable=False, after="o_orderkey"),
        RenameColumn("o_orderstatus", "status"),
        ChangeColumn("price_cents", "amount_cents", "bigint"),
        ModifyColumn("o_custkey", "int", after="amount_cents"),
    ]


def migrate_table(spark, d):
    name = _name("orders_migrated")
    log = rows(spark, d).select("seq", "pos", "event_type", *_COLS, KEY_BEFORE)
    keys = [KeySpec("by_customer", ("o_custkey",)), KeySpec("primary", (KEY,), True)]
    published = migrate(snapshot(spark, d), migration_ops(), log, keys, name, path=new_path(spark, name), before_key=KEY_BEFORE)
    return published


MIGRATE_TABLE = f"""
SELECT o_orderkey, '' AS note, o_orderstatus AS status, price_cents AS amount_cents, CAST(o_custkey AS INTEGER) AS o_custkey FROM ({APPLY_CHANGES})
"""

QUERIES = {
    "progress_json": (progress_json, PROGRESS_JSON),
    "table_checksum": (table_checksum, TABLE_CHECKSUM),
    "chunk_checksums": (chunk_checksums, CHUNK_CHECKSUMS),
    "compare_tables": (compare_tables, COMPARE_TABLES),
    "snapshot_diff": (snapshot_diff, SNAPSHOT_DIFF),
    "publish": (publish, ALTERED_ORDERS),
    "migrate_table": (migrate_table, MIGRATE_TABLE),
}
