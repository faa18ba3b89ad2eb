"""Change-log queries."""

from pyspark.sql import functions as F

from ..operators import changelog as op
from ..plans.staging import new_path
from ..sources.logs import read_change_log as read_log, write_change_log
from ..sources.tables import table
from ..sources.views import view, with_views

KEY = "o_orderkey"
KEY_BEFORE = "key_before"
COLS = ["o_custkey", "o_orderstatus", "price_cents"]


def log(spark, d):
    return view(spark, d, "change_log")


def rows(spark, d):
    return op.row_events(log(spark, d), "shop", "orders")


def snapshot(spark, d):
    return view(spark, d, "snapshot")


_SEQ = "CAST(substr(file, 8) AS BIGINT) AS seq"


def read_change_log(spark, d):
    path = new_path(spark, "change-log")
    write_change_log(log(spark, d), path)
    return read_log(spark, path, ("binlog.10", 1000))


def route_events(spark, d):
    return op.route_events(log(spark, d), "shop", "orders", "orders_hints")


def order_events(spark, d):
    return op.order_events(log(spark, d))


def events_between(spark, d):
    return op.events_between(log(spark, d), ("binlog.9", 5000), ("binlog.13", 9000))


EVENTS_BETWEEN = with_views("change_log", f"""
WITH s AS (SELECT *, {_SEQ} FROM change_log)
SELECT *, EXISTS (SELECT 1 FROM s WHERE (seq, pos) >= (13, 9000)) AS reached FROM s
WHERE (seq > 9 OR (seq = 9 AND pos > 5000)) AND (seq < 13 OR (seq = 13 AND pos <= 9000))
""")


def latest_change(spark, d):
    return op.latest_change(rows(spark, d), KEY)


LATEST_CHANGE = with_views("row_log", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC, pos DESC) AS rn FROM row_log) WHERE rn = 1
""")


def apply_inserts(spark, d):
    return op.apply_inserts(snapshot(spark, d), rows(spark, d), KEY)


_LAST = """l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC, pos DESC) AS rn
 FROM row_log WHERE event_type = '{kind}') WHERE rn = 1)"""

APPLY_INSERTS = with_views("snapshot row_log", f"""
WITH {_LAST.format(kind='WriteRows')}
SELECT s.* FROM snapshot s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, price_cents FROM l
""")


def apply_updates(spark, d):
    return op.apply_updates(snapshot(spark, d), rows(spark, d), KEY, KEY_BEFORE)


def apply_partial_updates(spark, d):
    return op.apply_partial_updates(snapshot(spark, d), rows(spark, d), KEY, ["o_orderstatus", "price_cents"])


APPLY_PARTIAL_UPDATES = with_views("snapshot row_log", """
WITH u AS (SELECT o_orderkey,
  max_by(o_orderstatus, (seq, pos)) FILTER (WHERE o_orderstatus IS NOT NULL) AS st,
  max_by(price_cents, (seq, pos)) FILTER (WHERE price_cents IS NOT NULL) AS pc
  FROM row_log WHERE event_type = 'UpdateRows' GROUP BY 1)
SELECT s.o_orderkey, s.o_custkey, coalesce(u.st, s.o_orderstatus) AS o_orderstatus, coalesce(u.pc, s.price_cents) AS price_cents
FROM snapshot s LEFT JOIN u USING (o_orderkey)
""")


def apply_deletes(spark, d):
    return op.apply_deletes(snapshot(spark, d), rows(spark, d), KEY)


APPLY_DELETES = with_views("snapshot row_log", """
SELECT * FROM snapshot WHERE o_orderkey NOT IN (SELECT o_orderkey FROM row_log WHERE event_type = 'DeleteRows')
""")


def apply_changes(spark, d):
    return op.apply_changes(snapshot(spark, d), rows(spark, d), KEY, before_key=KEY_BEFORE)


_APPLY = """
each AS (SELECT seq, pos, 1 AS ord, o_orderkey, CASE WHEN event_type = 'UpdateRows' AND key_before <> o_orderkey THEN 'WriteRows' ELSE event_type END AS event_type,
  o_custkey, o_orderstatus, price_cents FROM {log}
 UNION ALL SELECT seq, pos, 0, key_before, 'DeleteRows', NULL, NULL, NULL FROM {log} WHERE event_type = 'UpdateRows' AND key_before <> o_orderkey),
last_event AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC, pos DESC, ord DESC) AS rn FROM each) WHERE rn = 1),
last_life AS (SELECT o_orderkey, event_type AS life FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC, pos DESC, ord DESC) AS rn
  FROM each WHERE event_type IN ('WriteRows', 'DeleteRows')) WHERE rn = 1)
SELECT s.* FROM snapshot s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last_event)
UNION ALL SELECT e.o_orderkey, e.o_custkey, e.o_orderstatus, e.price_cents
FROM last_event e LEFT JOIN last_life f USING (o_orderkey) LEFT JOIN snapshot s USING (o_orderkey)
WHERE life = 'WriteRows' OR (life IS NULL AND s.o_orderkey IS NOT NULL)
"""
APPLY_UPDATES = with_views("snapshot row_log", """
WITH updates AS (SELECT * FROM row_log WHERE event_type = 'UpdateRows'),
""" + _APPLY.format(log="updates").strip())
APPLY_CHANGES = with_views("snapshot row_log", "WITH " + _APPLY.format(log="row_log").strip())


def bad_event():
    """No key, an insert without an after image, an update without a before image."""
    kind = F.col("event_type")
    return (
        F.col(KEY).isNull()
        | ((kind == op.INSERT) & F.col("price_cents").isNull())
        | ((kind == op.UPDATE) & F.col("cents_before").isNull())
    )


def apply_transactions(spark, d):
    return op.apply_transactions(snapshot(spark, d), rows(spark, d), KEY, "tx_id", bad_event(), KEY_BEFORE)


APPLY_TRANSACTIONS = with_views("snapshot row_log", """
WITH good AS (SELECT * FROM row_log WHERE tx_id NOT IN (SELECT tx_id FROM row_log WHERE o_orderkey IS NULL
  OR (event_type = 'WriteRows' AND price_cents IS NULL) OR (event_type = 'UpdateRows' AND cents_before IS NULL))),
""" + _APPLY.format(log="good").strip())


def changed_cells(spark, d):
    return op.changed_cells(
        rows(spark, d), KEY,
        {"o_orderstatus": ("st_before", "o_orderstatus"), "price_cents": ("cents_before", "price_cents")},
    )


CHANGED_CELLS = with_views("row_log", """
SELECT * FROM (
 SELECT seq, pos, o_orderkey, 'o_orderstatus' AS column_name, st_before AS before_value, o_orderstatus AS after_value FROM row_log
 UNION ALL SELECT seq, pos, o_orderkey, 'price_cents', CAST(cents_before AS VARCHAR), CAST(price_cents AS VARCHAR) FROM row_log)
WHERE before_value IS DISTINCT FROM after_value
""")


def change_statements(spark, d):
    return op.change_statements(rows(spark, d), KEY, COLS, KEY_BEFORE)


def _sql_text(c):
    return f"coalesce('''' || CAST({c} AS VARCHAR) || '''', 'NULL')"


CHANGE_STATEMENTS_BODY = f"""
SELECT seq, pos, o_orderkey, CASE event_type
 WHEN 'WriteRows' THEN 'INSERT INTO `shop`.`orders` (`o_orderkey`, `o_custkey`, `o_orderstatus`, `price_cents`) VALUES ('
   || {_sql_text('o_orderkey')} || ', ' || {_sql_text('o_custkey')} || ', ' || {_sql_text('o_orderstatus')} || ', ' || {_sql_text('price_cents')} || ')'
 WHEN 'UpdateRows' THEN 'UPDATE `shop`.`orders` SET ' || CASE WHEN key_before <> o_orderkey THEN '`o_orderkey` = ' || {_sql_text('o_orderkey')} || ', ' ELSE '' END || '`o_custkey` = ' || {_sql_text('o_custkey')} || ', `o_orderstatus` = ' || {_sql_text('o_orderstatus')}
   || ', `price_cents` = ' || {_sql_text('price_cents')} || ' WHERE `o_orderkey` = ' || {_sql_text('coalesce(key_before, o_orderkey)')}
 ELSE 'DELETE FROM `shop`.`orders` WHERE `o_orderkey` = ' || {_sql_text('o_orderkey')} END AS stmt FROM row_log
"""


def event_counts(spark, d):
    return op.event_counts(log(spark, d))


EVENT_COUNTS = with_views("change_log", """
SELECT file, tbl, event_type, count(*) AS events,
 count(*) FILTER (WHERE event_type IN ('WriteRows','UpdateRows','DeleteRows')) AS row_events,
 CAST(GROUPING(file, tbl, event_type) AS BIGINT) AS level FROM change_log GROUP BY ROLLUP (file, tbl, event_type)
""")


def raw_bytes(spark, d):
    """Raw events as bytes; some are cut short as a broken log would have them."""
    fields = view(spark, d, "raw_events")
    filler = F.unhex(F.lit("00" * 10))
    whole = F.concat(
        op.to_little_endian(F.col("unix_ts"), 4), op.to_little_endian(F.col("type_code"), 1),
        op.to_little_endian(F.col("server_id"), 4), filler,
    )
    cut = F.when(F.col("event_id") % 97 == 0, F.substring(whole, 1, 10)).otherwise(whole)
    return fields.select("event_id", cut.alias("data"))


def decode_events(spark, d):
    return op.decode_events(raw_bytes(spark, d), "data")


DECODE_EVENTS = with_views("raw_events", """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'Unknown' WHEN type_code = 19 THEN 'WriteRows' WHEN type_code = 20 THEN 'UpdateRows'
 WHEN type_code = 21 THEN 'DeleteRows' WHEN type_code = 2 THEN 'Query' ELSE 'Unknown' END AS event_type,
 CASE WHEN event_id % 97 <> 0 THEN CAST(unix_ts AS BIGINT) END AS unix_ts,
 CASE WHEN event_id % 97 <> 0 THEN server_id END AS server_id,
 CAST(NULL AS BIGINT) AS next_pos, CAST(NULL AS VARCHAR) AS next_file FROM raw_events
""")


def current_file(spark, d):
    return op.current_file(log(spark, d))


CURRENT_FILE = with_views("change_log", f"""
WITH s AS (SELECT *, {_SEQ} FROM change_log),
r AS (SELECT file AS named, (seq, pos) AS turn FROM s WHERE event_type = 'Rotate')
SELECT s.*, (SELECT max_by(named, turn) FROM r WHERE turn <= (s.seq, s.pos)) AS current_file FROM s
""")


def locate_events(spark, d):
    events = log(spark, d)
    return op.locate_events(events, op.log_files(events)).select(
        "seq", "pos", "event_type", KEY, "in_file", "start_pos", "end_pos", "previous_file", "next_file"
    )


LOCATE_EVENTS = with_views("change_log", f"""
WITH s AS (SELECT *, {_SEQ} FROM change_log),
f AS (SELECT seq, file AS in_file, min(pos) AS start_pos, max(pos) AS end_pos FROM s GROUP BY ALL),
g AS (SELECT *, lag(in_file) OVER (ORDER BY seq) AS previous_file, lead(in_file) OVER (ORDER BY seq) AS next_file FROM f)
SELECT s.seq, s.pos, s.event_type, s.o_orderkey, in_file, start_pos, end_pos, previous_file, next_file
FROM s JOIN g ON s.seq = g.seq AND s.pos BETWEEN g.start_pos AND g.end_pos
""")


def gtids_with_time(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("replica"))
    return view(spark, d, "gtids").join(events, "event_id")


def executed_set(spark, d):
    gtids = gtids_with_time(spark, d)
    per_replica = op.executed_set(gtids, "gtid", ["replica"])
    every = op.executed_set(gtids, "gtid").withColumn("replica", F.lit("all"))
    return per_replica.unionByName(every)


_DOMAINS = """p AS (SELECT g.event_id, g.gtid, e.ts, e.event_type AS replica, split_part(gtid, ':', 1) AS domain,
 TRY_CAST(split_part(gtid, ':', 2) AS BIGINT) AS seq FROM gtids g JOIN events e USING (event_id)
 WHERE split_part(gtid, ':', 1) <> '' AND TRY_CAST(split_part(gtid, ':', 2) AS BIGINT) > 0)"""

EXECUTED_SET = with_views("gtids", f"""
WITH {_DOMAINS},
m AS (SELECT replica, domain, max(seq) AS s FROM p GROUP BY ALL UNION ALL SELECT 'all', domain, max(seq) FROM p GROUP BY ALL)
SELECT replica, string_agg(domain || ':' || s, ',' ORDER BY domain || ':' || s) AS gtid_set, count(*) AS domains FROM m GROUP BY replica
""")

_MOMENT = "2024-01-16 00:00:00"


def pending_events(spark, d):
    gtids = gtids_with_time(spark, d)
    executed = op.executed_domains(gtids.where(F.col("ts") < F.lit(_MOMENT).cast("timestamp_ntz")), "gtid")
    return op.pending_events(gtids, "gtid", executed)


PENDING_EVENTS = with_views("gtids", f"""
WITH {_DOMAINS}, x AS (SELECT domain, max(seq) AS max_seq FROM p WHERE ts < TIMESTAMP '{_MOMENT}' GROUP BY 1)
SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.domain = p.domain AND p.seq <= x.max_seq)
UNION ALL BY NAME SELECT g.event_id, g.gtid, e.ts, e.event_type AS replica, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS BIGINT) AS seq
 FROM gtids g JOIN events e USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.event_id = g.event_id)
""")

QUERIES = {
    "read_change_log": (
        read_change_log,
        with_views("change_log", f"SELECT * FROM (SELECT *, {_SEQ} FROM change_log) WHERE (seq, pos) >= (10, 1000)"),
    ),
    "route_events": (
        route_events,
        with_views("change_log", """SELECT * FROM change_log WHERE tbl = 'orders_hints' OR (event_type IN ('WriteRows','UpdateRows','DeleteRows')
        AND db = 'shop' AND tbl = 'orders') OR event_type IN ('Rotate', 'Query')"""),
    ),
    "order_events": (order_events, with_views("change_log", f"SELECT *, {_SEQ} FROM change_log ORDER BY seq, pos")),
    "events_between": (events_between, EVENTS_BETWEEN),
    "latest_change": (latest_change, LATEST_CHANGE),
    "apply_inserts": (apply_inserts, APPLY_INSERTS),
    "apply_updates": (apply_updates, APPLY_UPDATES),
    "apply_partial_updates": (apply_partial_updates, APPLY_PARTIAL_UPDATES),
    "apply_deletes": (apply_deletes, APPLY_DELETES),
    "apply_changes": (apply_changes, APPLY_CHANGES),
    "apply_transactions": (apply_transactions, APPLY_TRANSACTIONS),
    "changed_cells": (changed_cells, CHANGED_CELLS),
    "change_statements": (change_statements, with_views("row_log", CHANGE_STATEMENTS_BODY)),
    "event_counts": (event_counts, EVENT_COUNTS),
    "decode_events": (decode_events, DECODE_EVENTS),
    "current_file": (current_file, CURRENT_FILE),
    "locate_events": (locate_events, LOCATE_EVENTS),
    "executed_set": (executed_set, EXECUTED_SET),
    "pending_events": (pending_events, PENDING_EVENTS),
}
