"""Derived inputs as SQL that Spark and DuckDB both run.

They turn the given tables into a row change log, a hint log, load samples,
transaction ids, endpoints, ALTER statements and raw event fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import register

CHANGE_LOG_COLUMNS = (
    "file pos tx_id db tbl event_type o_orderkey o_custkey o_orderstatus "
    "price_cents st_before cents_before key_before"
).split()

CHANGE_LOG = """
WITH e(step) AS (VALUES (1),(2),(3),(4),(5),(6),(7),(8)),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders),
d AS (
 SELECT 1 AS step, 'UpdateRows' AS event_type, o_orderkey AS k, o_custkey, 'U' AS st, cents+100 AS cents_after, CASE WHEN o_orderkey%500<>5 THEN o_orderstatus END AS st_before, CASE WHEN o_orderkey%500<>5 THEN cents END AS cents_before, o_orderkey AS k_before FROM o WHERE o_orderkey%5=0
 UNION ALL SELECT 2,'UpdateRows',o_orderkey,o_custkey,CAST(NULL AS STRING),cents+200,'U',cents+100,o_orderkey FROM o WHERE o_orderkey%10=0
 UNION ALL SELECT 3,'DeleteRows',o_orderkey,CAST(NULL AS BIGINT),CAST(NULL AS STRING),CAST(NULL AS BIGINT),CAST(NULL AS STRING),cents+200,o_orderkey FROM o WHERE o_orderkey%20=0
 UNION ALL SELECT 4,'WriteRows',o_orderkey+10000000,o_custkey,'N',cents,CAST(NULL AS STRING),CAST(NULL AS BIGINT),CAST(NULL AS BIGINT) FROM o WHERE o_orderkey%25=0
 UNION ALL SELECT 5,'WriteRows',o_orderkey,o_custkey,'R',cents+500,CAST(NULL AS STRING),CAST(NULL AS BIGINT),CAST(NULL AS BIGINT) FROM o WHERE o_orderkey%40=0 OR o_orderkey%70=0
 UNION ALL SELECT 6,'UpdateRows',o_orderkey+20000000,o_custkey,'X',cents,'X',cents,o_orderkey+20000000 FROM o WHERE o_orderkey%50=0
 UNION ALL SELECT 7,'UpdateRows',o_orderkey+30000000,o_custkey,'M',cents+700,o_orderstatus,cents,o_orderkey FROM o WHERE o_orderkey%15=5
 UNION ALL SELECT 8,'UpdateRows',o_orderkey,o_custkey,'B',cents+800,'M',cents+700,o_orderkey+30000000 FROM o WHERE o_orderkey%45=5)
SELECT 'binlog.' || CAST(8+step AS STRING) AS file, CAST(120+(k%10000000)*8 AS BIGINT) AS pos,
 CAST(step*1000000+floor((k%10000000)/100) AS BIGINT) AS tx_id, 'shop' AS db,
 CASE WHEN k%7=6 THEN 'other' ELSE 'orders' END AS tbl, event_type, k AS o_orderkey, o_custkey, st AS o_orderstatus, cents_after AS price_cents, st_before, cents_before, k_before AS key_before
FROM d
UNION ALL SELECT 'binlog.' || CAST(8+step AS STRING), 4, CAST(NULL AS BIGINT), '', '', 'Rotate', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM e
UNION ALL SELECT 'binlog.9', 100+r_regionkey, CAST(NULL AS BIGINT), 'shop', '', 'Query', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM region
"""

HINTS = """
SELECT event_id AS id, user_id AS job, CASE event_type WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'shadow-table-migrated' WHEN 'purchase' THEN 'row-copy-complete' WHEN 'error' THEN 'cut-over-phase' ELSE 'good-to-go' END AS hint,
 CASE WHEN event_type='click' THEN CAST(CAST(floor(value*1000) AS BIGINT) AS STRING) ELSE 'binlog.' || CAST(CAST(9+floor(event_id/4000) AS BIGINT) AS STRING) || ':' || CAST(120+event_id*8 AS STRING) END AS value, ts FROM events
"""

METRICS = """
SELECT event_id AS tick, ts, event_type AS replica, CAST(floor(value) AS BIGINT) AS lag_s, event_id%64 AS threads_running, CASE WHEN event_id%17=0 THEN 1 ELSE 0 END AS query_value, user_id%29=0 AS user_flag FROM events
"""

GTIDS = """
SELECT event_id, 'dom-' || CAST(user_id%10 AS STRING) || ':' || CAST(event_id AS STRING) AS gtid FROM events
"""

ENDPOINTS = """
SELECT c_custkey AS id, CASE WHEN c_custkey%50=0 THEN 'invalid' WHEN c_custkey%51=0 THEN 'h:abc' ELSE ' host' || CAST(c_nationkey AS STRING) || ':' || CAST(3306+c_custkey%3 AS STRING) END AS endpoint FROM customer
"""

# One ALTER per part, its shape chosen by the part key, so that the log grows
# with the data.
DDL_LOG = """
SELECT p_partkey AS stmt_id, 'ALTER TABLE shop.t_' || CAST(p_partkey AS STRING) || ' ' || CASE p_partkey%21
 WHEN 0 THEN 'ADD COLUMN c1 INT' WHEN 1 THEN 'ADD c2 VARCHAR(255) NOT NULL AFTER c1' WHEN 2 THEN 'DROP COLUMN c3'
 WHEN 3 THEN 'DROP c4' WHEN 4 THEN 'MODIFY COLUMN c5 DECIMAL(10,2)' WHEN 5 THEN 'CHANGE c6 c7 BIGINT'
 WHEN 6 THEN 'ADD INDEX idx_a (c1, c2)' WHEN 7 THEN 'ADD UNIQUE KEY uk_b (c2)' WHEN 8 THEN 'ADD PRIMARY KEY (id)'
 WHEN 9 THEN 'DROP PRIMARY KEY' WHEN 10 THEN 'DROP INDEX idx_a' WHEN 11 THEN 'ENGINE = InnoDB' WHEN 12 THEN 'RENAME TO t_new'
 WHEN 13 THEN 'ADD COLUMN c8 INT FIRST, DROP COLUMN c9, ADD INDEX idx_c (c1, c2)' WHEN 14 THEN 'COMMENT x /* note */'
 WHEN 15 THEN 'RENAME COLUMN c10 TO c11' WHEN 16 THEN 'ADD user_key INT' WHEN 17 THEN 'MODIFY c12 TIMESTAMP NOT NULL'
 WHEN 18 THEN 'CHANGE COLUMN c13 c14 INT UNSIGNED' WHEN 19 THEN 'ADD c15 INT COMMENT "x,y (z", DROP c16'
 ELSE 'ADD c17 VARCHAR(9) DEFAULT ' || chr(39) || 'it' || chr(92) || chr(39) || 's, ok' || chr(39) || ', DROP COLUMN c18' END AS stmt FROM part
"""

RAW_EVENTS = """
SELECT event_id, CASE event_type WHEN 'click' THEN 19 WHEN 'view' THEN 20 WHEN 'purchase' THEN 21 WHEN 'error' THEN 2 ELSE 99 END AS type_code, user_id AS server_id, 1700000000+event_id AS unix_ts FROM events
"""

# orders in the shape the change log carries
SNAPSHOT = """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice*100) AS BIGINT) AS price_cents FROM orders
"""

# the change log once routed to the table it changes
ROW_LOG = """
SELECT *, CAST(substr(file, 8) AS BIGINT) AS seq FROM change_log
WHERE tbl = 'orders' AND event_type IN ('WriteRows','UpdateRows','DeleteRows')
"""

_VIEWS: dict[str, tuple[str, list[str]]] = {
    "change_log": (CHANGE_LOG, ["orders", "region"]),
    "hints": (HINTS, ["events"]),
    "metrics": (METRICS, ["events"]),
    "gtids": (GTIDS, ["events"]),
    "endpoints": (ENDPOINTS, ["customer"]),
    "ddl_log": (DDL_LOG, ["part"]),
    "raw_events": (RAW_EVENTS, ["events"]),
    "snapshot": (SNAPSHOT, ["orders"]),
    "row_log": (ROW_LOG, ["change_log"]),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    text, needs = _VIEWS[name]
    derived = [n for n in needs if n in _VIEWS]
    register(spark, folder, [n for n in needs if n not in _VIEWS])
    for n in derived:
        view(spark, folder, n).createOrReplaceTempView(n)
    return spark.sql(text)


def with_views(names: str, sql: str) -> str:
    """Prefix oracle SQL with the derived inputs it reads."""
    order: list[str] = []
    for name in names.split():
        for n in [*[d for d in _VIEWS[name][1] if d in _VIEWS], name]:
            if n not in order:
                order.append(n)
    body = sql.strip()
    more = body[4:].lstrip() if body.upper().startswith("WITH ") else None
    recursive = ""
    if more and more.upper().startswith("RECURSIVE "):
        recursive, more = "RECURSIVE ", more[len("RECURSIVE "):]
    ctes = ",\n".join(f"{n} AS ({_VIEWS[n][0]})" for n in order)
    return f"WITH {recursive}{ctes}" + (f",\n{more}" if more else f"\n{body}")
