"""Derived inputs: the whole test tables with missing values and copies injected.

Each builder has a SQL twin with the same name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.registry import Tables


def gappy_lines(t: Tables) -> DataFrame:
    """lineitem with missing quantities, flags, prices and dates."""
    return t.lineitem.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price",
        "l_discount AS discount",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag",
        "l_linestatus AS status",
        "CASE WHEN l_orderkey % 50 = 1 THEN NULL ELSE l_shipdate END AS shipdate",
    )


def gappy_orders(t: Tables) -> DataFrame:
    """orders with a missing status and priority in some rows."""
    return t.orders.selectExpr(
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status",
        "o_totalprice AS price",
        "o_orderdate AS orderdate",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "CAST(o_orderkey % 3 AS INT) AS code",
    )


def text_lines(t: Tables) -> DataFrame:
    """lineitem as text: numbers with junk among them, dates in ISO form."""
    return t.lineitem.select(
        F.expr(
            "CASE WHEN l_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS STRING)"
            " END"
        ).alias("quantity"),
        F.when(F.expr("l_orderkey % 20 = 0"), F.lit("unknown"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("shipped"),
        "l_returnflag",
    )


def few_columns(t: Tables) -> DataFrame:
    """A projection of lineitem that is full of equal rows."""
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")


def skewed_lines(t: Tables) -> DataFrame:
    """lineitem with a long-tailed column."""
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        (F.col("l_quantity") * F.col("l_quantity") * F.col("l_extendedprice")).alias("tail"),
    )


def patchy_months(t: Tables) -> DataFrame:
    """orders without dates in the second and third month of every year."""
    return t.orders.select(
        F.when(~F.month("o_orderdate").isin(2, 3), F.col("o_orderdate")).alias("orderdate"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )


SQL = {
    "gappy_lines": """(SELECT l_orderkey, l_linenumber,
        CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price,
        l_discount AS discount,
        CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag,
        l_linestatus AS status,
        CASE WHEN l_orderkey % 50 = 1 THEN NULL ELSE l_shipdate END AS shipdate
        FROM lineitem)""",
    "gappy_orders": """(SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status,
        o_totalprice AS price, o_orderdate AS orderdate,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
        CAST(o_orderkey % 3 AS INT) AS code
        FROM orders)""",
    "text_lines": """(SELECT
        CASE WHEN l_orderkey % 10 = 0 THEN 'n/a'
             ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity,
        CASE WHEN l_orderkey % 20 = 0 THEN 'unknown'
             ELSE strftime(l_shipdate, '%Y-%m-%d') END AS shipped,
        l_returnflag FROM lineitem)""",
    "few_columns": "(SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)",
    "skewed_lines": """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
        l_quantity * l_quantity * l_extendedprice AS tail FROM lineitem)""",
    "patchy_months": """(SELECT
        CASE WHEN month(o_orderdate) NOT IN (2, 3) THEN o_orderdate END AS orderdate,
        o_totalprice AS price, o_orderstatus AS status FROM orders)""",
}
