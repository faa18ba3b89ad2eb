"""Inspection queries."""


from ..operators import inspect as op
from ..operators.alter import AddColumn, ModifyColumn, alter_table
from ..operators.inspect import KeySpec
from ..sources.tables import footer_table, table


def column_profile(spark, d):
    return op.column_profile(table(spark, d, "customer"))


_COLUMNS = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
    ("c_acctbal", "double"), ("c_mktsegment", "string"),
]
COLUMN_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS data_type, TRUE AS nullable, count(*) AS "rows",
    count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values,
    CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer"""
    for c, t in _COLUMNS
)


def key_check(spark, d):
    orders = op.key_check(
        table(spark, d, "orders"),
        [KeySpec("primary", ("o_orderkey",), True), KeySpec("by_customer", ("o_custkey",))],
    )
    lineitem = op.key_check(
        table(spark, d, "lineitem"), [KeySpec("line", ("l_orderkey", "l_linenumber"))]
    )
    return orders.unionByName(lineitem)


def _key_check_sql(name, table_name, cols):
    missing = " OR ".join(f"{c} IS NULL" for c in cols)
    key = ", ".join(cols)
    return f"""SELECT '{name}' AS key_name, count(*) AS "rows",
    (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table_name} WHERE NOT ({missing}))) AS distinct_keys,
    count(*) FILTER (WHERE NOT ({missing})) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table_name} WHERE NOT ({missing}))) AS duplicates,
    count(*) FILTER (WHERE {missing}) AS null_rows FROM {table_name}"""


KEY_CHECK = "SELECT *, duplicates = 0 AND null_rows = 0 AS usable FROM (" + " UNION ALL ".join(
    [
        _key_check_sql("primary", "orders", ["o_orderkey"]),
        _key_check_sql("by_customer", "orders", ["o_custkey"]),
        _key_check_sql("line", "lineitem", ["l_orderkey", "l_linenumber"]),
    ]
) + ")"


def shared_key(spark, d):
    orders = table(spark, d, "orders")
    shadow = alter_table(
        orders, [AddColumn("note", "varchar(20)"), ModifyColumn("o_totalprice", "decimal(12,2)")]
    )
    return op.shared_key(
        orders,
        shadow,
        [
            KeySpec("by_customer", ("o_custkey",)),
            KeySpec("by_customer_order", ("o_custkey", "o_orderkey")),
            KeySpec("primary", ("o_orderkey",), True),
        ],
    )


SHARED_KEY = """
WITH c(rnk, key_name, key_columns, is_primary, ok) AS (
  SELECT 1, 'primary', 'o_orderkey', TRUE, count(*) = count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 2, 'by_customer', 'o_custkey', FALSE, count(*) = count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 3, 'by_customer_order', 'o_custkey,o_orderkey', FALSE, count(*) = count(DISTINCT (o_custkey, o_orderkey)) FROM orders)
SELECT key_name, key_columns, is_primary FROM c WHERE ok ORDER BY rnk LIMIT 1
"""


def duplicate_key_rows(spark, d):
    return op.duplicate_key_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE_KEY_ROWS = """
SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1
"""


def orphan_rows(spark, d):
    """Documents that nobody has labelled."""
    return op.orphan_rows(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id")


ORPHAN_ROWS = """
SELECT d.* FROM documents d WHERE doc_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""


def row_count_exact(spark, d):
    return op.row_count_exact(footer_table(spark, f"{d}/orders.parquet"))


def row_count_estimate(spark, d):
    return op.row_count_estimate(spark, f"{d}/orders.parquet")


def key_range(spark, d):
    return op.key_range(footer_table(spark, f"{d}/orders.parquet"), "o_orderkey")


QUERIES = {
    "column_profile": (column_profile, COLUMN_PROFILE),
    "key_check": (key_check, KEY_CHECK),
    "shared_key": (shared_key, SHARED_KEY),
    "duplicate_key_rows": (duplicate_key_rows, DUPLICATE_KEY_ROWS),
    "orphan_rows": (orphan_rows, ORPHAN_ROWS),
    "row_count_exact": (row_count_exact, 'SELECT count(*) AS "rows" FROM orders'),
    "row_count_estimate": (
        row_count_estimate,
        "SELECT count(*) AS estimated_rows, CAST(0 AS DOUBLE) AS standard_error FROM orders",
    ),
    "key_range": (
        key_range,
        """SELECT coalesce(CAST(min(o_orderkey) AS VARCHAR), '0') AS min_key,
        coalesce(CAST(max(o_orderkey) AS VARCHAR), '0') AS max_key FROM orders""",
    ),
}
