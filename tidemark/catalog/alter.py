"""Schema change queries."""

from pyspark.sql import functions as F

from ..operators import alter as op
from ..operators.alter import (
    AddColumn, ChangeColumn, DropColumn, ModifyColumn, RenameColumn, TableOption,
)
from ..sources.tables import table


def add_column(spark, d):
    return op.alter_table(
        table(spark, d, "orders"),
        [
            AddColumn("region_id", "int", default=7, nullable=False, first=True),
            AddColumn("note", "varchar(64)", after="o_custkey"),
            AddColumn("source", "varchar(16)", default="import"),
        ],
    )


def drop_column(spark, d):
    return op.drop_column(table(spark, d, "orders"), "O_ORDERPRIORITY")


def modify_column(spark, d):
    return op.modify_column(table(spark, d, "orders"), "o_custkey", "int", after="o_totalprice")


def change_column(spark, d):
    return op.change_column(table(spark, d, "orders"), "o_orderdate", "ordered_on", "date")


def rename_column(spark, d):
    return op.rename_column(table(spark, d, "customer"), "c_mktsegment", "segment")


def orders_ops():
    """The schema change used by the whole-table queries."""
    return [
        AddColumn("note", "varchar(64)", default="", nullable=False, after="o_orderkey"),
        DropColumn("o_orderpriority"),
        ChangeColumn(
            "o_totalprice", "price_cents", "bigint",
            expression=F.round(F.col("o_totalprice") * 100),
        ),
        ModifyColumn("o_orderdate", "date"),
        RenameColumn("o_orderstatus", "status"),
        TableOption("add_index", "idx_customer", ("o_custkey",)),
    ]


ALTERED_ORDERS = """
SELECT o_orderkey, '' AS note, o_custkey, o_orderstatus AS status,
 CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
"""


def alter_table(spark, d):
    return op.alter_table(table(spark, d, "orders"), orders_ops())


def add_unique_key(spark, d):
    customer = table(spark, d, "customer")
    by_name = op.add_unique_key(customer, ["c_name"], primary=True)
    by_segment = op.add_unique_key(customer, ["c_nationkey", "c_mktsegment"])
    return by_name.withColumn("key_name", F.lit("name")).unionByName(
        by_segment.withColumn("key_name", F.lit("segment"))
    )


ADD_UNIQUE_KEY = """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY c_name) AS n, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m FROM customer)
SELECT * EXCLUDE (n, m), 'duplicate' AS reason, 'name' AS key_name FROM c WHERE n > 1 AND c_name IS NOT NULL
UNION ALL SELECT * EXCLUDE (n, m), 'null', 'name' FROM c WHERE c_name IS NULL
UNION ALL SELECT * EXCLUDE (n, m), 'duplicate', 'segment' FROM c WHERE m > 1 AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL
"""


def cast_audit(spark, d):
    orders = op.cast_audit(
        table(spark, d, "orders"),
        [
            ModifyColumn("o_orderpriority", "varchar(8)", nullable=False),
            ModifyColumn("o_orderstatus", "enum('O','F')", values=("O", "F")),
            ModifyColumn("o_custkey", "tinyint"),
            ModifyColumn("o_orderdate", "date"),
            ModifyColumn("o_totalprice", "float"),
        ],
    )
    customer = op.cast_audit(
        table(spark, d, "customer"),
        [ModifyColumn("c_name", "bigint"), ChangeColumn("c_mktsegment", "segment", "char(9)")],
    )
    return orders.unionByName(customer)


CAST_AUDIT = """
SELECT 'o_orderpriority' AS column_name, 'cast' AS reason, count(*) FILTER (WHERE FALSE) AS bad_rows FROM orders
UNION ALL SELECT 'o_orderpriority', 'length', count(*) FILTER (WHERE length(o_orderpriority) > 8) FROM orders
UNION ALL SELECT 'o_orderpriority', 'null', count(*) - count(o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderstatus', 'cast', count(*) FILTER (WHERE FALSE) FROM orders
UNION ALL SELECT 'o_orderstatus', 'value', count(*) FILTER (WHERE o_orderstatus NOT IN ('O','F')) FROM orders
UNION ALL SELECT 'o_custkey', 'cast', count(*) FILTER (WHERE TRY_CAST(o_custkey AS TINYINT) IS NULL AND o_custkey IS NOT NULL) FROM orders
UNION ALL SELECT 'o_orderdate', 'cast', count(*) FILTER (WHERE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) <> o_orderdate) FROM orders
UNION ALL SELECT 'o_totalprice', 'cast', count(*) FILTER (WHERE CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) <> o_totalprice) FROM orders
UNION ALL SELECT 'c_name', 'cast', count(*) FILTER (WHERE TRY_CAST(c_name AS BIGINT) IS NULL AND c_name IS NOT NULL) FROM customer
UNION ALL SELECT 'c_mktsegment', 'cast', count(*) FILTER (WHERE FALSE) FROM customer
UNION ALL SELECT 'c_mktsegment', 'length', count(*) FILTER (WHERE length(c_mktsegment) > 9) FROM customer
"""

_LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def add_auto_increment(spark, d):
    return op.add_auto_increment(table(spark, d, "lineitem"), _LINE_ORDER, "line_id")


ADD_AUTO_INCREMENT = f"""
SELECT row_number() OVER (ORDER BY {', '.join(c + ' NULLS FIRST' for c in _LINE_ORDER)}) AS line_id, * FROM lineitem
"""


def schema_diff(spark, d):
    orders = table(spark, d, "orders")
    return op.schema_diff(orders, op.alter_table(orders, orders_ops()))


SCHEMA_DIFF = """
WITH a AS (
  SELECT 'o_orderkey' AS column_name, 'bigint' AS t, count(*) - count(o_orderkey) AS n FROM orders
  UNION ALL SELECT 'o_custkey', 'bigint', count(*) - count(o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', 'string', count(*) - count(o_orderstatus) FROM orders
  UNION ALL SELECT 'o_totalprice', 'double', count(*) - count(o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(*) - count(o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', 'string', count(*) - count(o_orderpriority) FROM orders),
b AS (
  SELECT 'o_orderkey' AS column_name, 'bigint' AS t, count(*) - count(o_orderkey) AS n FROM orders
  UNION ALL SELECT 'note', 'string', count(*) FILTER (WHERE FALSE) FROM orders
  UNION ALL SELECT 'o_custkey', 'bigint', count(*) - count(o_custkey) FROM orders
  UNION ALL SELECT 'status', 'string', count(*) - count(o_orderstatus) FROM orders
  UNION ALL SELECT 'price_cents', 'bigint', count(*) - count(o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderdate', 'date', count(*) - count(o_orderdate) FROM orders)
SELECT column_name, a.t AS original_type, b.t AS shadow_type, a.n AS original_nulls, b.n AS shadow_nulls,
 CASE WHEN b.t IS NULL THEN 'only_original' WHEN a.t IS NULL THEN 'only_shadow' ELSE 'both' END AS presence,
 coalesce(a.t = b.t, FALSE) AS same_type
FROM a FULL JOIN b USING (column_name)
"""

QUERIES = {
    "add_column": (
        add_column,
        """SELECT 7 AS region_id, o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS note, o_orderstatus,
        o_totalprice, o_orderdate, o_orderpriority, 'import' AS source FROM orders""",
    ),
    "drop_column": (drop_column, "SELECT * EXCLUDE (o_orderpriority) FROM orders"),
    "modify_column": (
        modify_column,
        """SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_custkey AS INTEGER) AS o_custkey,
        o_orderdate, o_orderpriority FROM orders""",
    ),
    "change_column": (
        change_column,
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS ordered_on,
        o_orderpriority FROM orders""",
    ),
    "rename_column": (
        rename_column,
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer",
    ),
    "alter_table": (alter_table, ALTERED_ORDERS),
    "add_unique_key": (add_unique_key, ADD_UNIQUE_KEY),
    "cast_audit": (cast_audit, CAST_AUDIT),
    "add_auto_increment": (add_auto_increment, ADD_AUTO_INCREMENT),
    "schema_diff": (schema_diff, SCHEMA_DIFF),
}
