"""Queries on cleaning, ordering, sources and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.durable import shared_folder
from tablewright.forecast.prepare import interpolate
from tablewright.operators import clean, ordering
from tablewright.plans.inputs import SQL, few_columns, gappy_lines, gappy_orders, text_lines
from tablewright.plans.registry import Tables, query, rounded
from tablewright.sources import nested, reports, tables as files

LINES, ORDERS, TEXT = SQL["gappy_lines"], SQL["gappy_orders"], SQL["text_lines"]
COPIES = SQL["few_columns"]

# Cleaning --------------------------------------------------------------

_KEYS = "l_orderkey, l_linenumber"
_TARGETS = ["quantity", "price", "flag"]


def _totals_sql(source: str) -> str:
    """Per line status: row count and checks on every filled column."""
    return f"""
        SELECT status, count(*) AS rows, count(quantity) AS quantities,
               round(sum(quantity), 2) AS quantity, count(price) AS prices,
               round(sum(price), 2) AS price, count(flag) AS flags,
               count(*) FILTER (flag = 'A') AS flag_a, count(*) FILTER (flag = 'R') AS flag_r
        FROM {source} GROUP BY status"""


def _totals(df: DataFrame) -> DataFrame:
    return rounded(
        df.groupBy("status").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("quantity").alias("quantities"),
            F.sum("quantity").alias("quantity"),
            F.count("price").alias("prices"),
            F.sum("price").alias("price"),
            F.count("flag").alias("flags"),
            F.count_if(F.col("flag") == "A").alias("flag_a"),
            F.count_if(F.col("flag") == "R").alias("flag_r"),
        )
    )


def _filled_sql(quantity: str, price: str, flag: str) -> str:
    return _totals_sql(
        f"""(SELECT status, coalesce(quantity, {quantity}) AS quantity,
             coalesce(price, {price}) AS price, coalesce(flag, {flag}) AS flag FROM {LINES})"""
    )


def _from_lines(fold: str) -> str:
    return f"(SELECT {fold} FROM {LINES})"


_MODE_FLAG = (
    f"(SELECT flag FROM {LINES} WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
)


def _mode_of(column: str) -> str:
    return (
        f"(SELECT {column} FROM {LINES} WHERE {column} IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)"
    )


_MEDIAN = _filled_sql(
    _from_lines("quantile_cont(quantity, 0.5)"), _from_lines("quantile_cont(price, 0.5)"), _MODE_FLAG
)
_CLEANED = {
    "drop_rows": _totals_sql(
        f"(SELECT * FROM {LINES} WHERE quantity IS NOT NULL AND price IS NOT NULL "
        "AND flag IS NOT NULL)"
    ),
    "zero": _filled_sql("0", "0", "'0'"),
    "mean": _filled_sql(_from_lines("avg(quantity)"), _from_lines("avg(price)"), _MODE_FLAG),
    "median": _MEDIAN,
    "mode": _filled_sql(_mode_of("quantity"), _mode_of("price"), _MODE_FLAG),
    "auto": _MEDIAN,
}

for _strategy, _sql in _CLEANED.items():

    @query(f"clean_{_strategy}", _sql)
    def _(t: Tables, strategy: str = _strategy):
        return _totals(clean.clean(gappy_lines(t), False, strategy, _TARGETS).df)


@query(
    "clean_drop_columns",
    f"SELECT status, count(*) AS rows, round(sum(discount), 2) AS discount FROM {LINES} GROUP BY 1",
)
def _(t: Tables):
    left = clean.clean(gappy_lines(t), False, "drop_columns").df
    if set(left.columns) != {"l_orderkey", "l_linenumber", "discount", "status"}:
        raise ValueError(f"columns left: {left.columns}")
    return rounded(
        left.groupBy("status").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("discount").alias("discount")
        )
    )


@query(
    "clean_log",
    f"""WITH d AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINES})) AS u
               FROM {LINES}),
         s AS (SELECT DISTINCT * FROM {LINES}),
         c AS (SELECT count(*) FILTER (quantity IS NULL) AS q,
                      count(*) FILTER (quantity IS NOT NULL AND price IS NULL) AS p,
                      count(*) FILTER (quantity IS NOT NULL AND price IS NOT NULL
                                       AND flag IS NULL) AS f FROM s)
    SELECT CAST(i AS INT) AS step, m AS message, n AS rows_before, u - q - p - f AS rows_after
    FROM (SELECT unnest([0, 1, 2, 3]) AS i,
                 unnest(['Dropped ' || (n - u) || ' duplicate rows',
                         'Dropped ' || q || ' rows with missing ''quantity''',
                         'Dropped ' || p || ' rows with missing ''price''',
                         'Dropped ' || f || ' rows with missing ''flag''']) AS m, n, u, q, p, f
          FROM d, c)""",
)
def _(t: Tables):
    return clean.clean(gappy_lines(t), True, "drop_rows", _TARGETS).log_df()


@query("drop_duplicate_rows", f"SELECT DISTINCT * FROM {COPIES}")
def _(t: Tables):
    return clean.drop_duplicate_rows(few_columns(t))


@query(
    "column_modes",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT CAST({c} AS VARCHAR) FROM {LINES}
            WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode"""
        for c in ("flag", "quantity", "status")
    ),
)
def _(t: Tables):
    return clean.column_modes(gappy_lines(t), ["flag", "quantity", "status"])


# Ordering --------------------------------------------------------------

_GAPPY_EVENTS = """(SELECT event_id, ts, event_type,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events)"""


def _gappy_events(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id",
        "ts",
        "event_type",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value",
    )


@query(
    "forward_fill",
    f"""SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id) AS value
    FROM {_GAPPY_EVENTS}""",
)
def _(t: Tables):
    filled = ordering.forward_fill(_gappy_events(t), ["value"], ["ts", "event_id"])
    return filled.select("event_id", "value")


@query(
    "forward_fill_by_group",
    f"""SELECT event_id, last_value(value IGNORE NULLS) OVER
           (PARTITION BY event_type ORDER BY ts, event_id) AS value FROM {_GAPPY_EVENTS}""",
)
def _(t: Tables):
    filled = ordering.forward_fill(
        _gappy_events(t), ["value"], ["ts", "event_id"], ["event_type"]
    )
    return filled.select("event_id", "value")


@query(
    "clean_forward_fill",
    """SELECT event_id, last_value(seen IGNORE NULLS) OVER (ORDER BY event_id) AS seen
    FROM (SELECT event_id, CASE WHEN event_id % 6 = 1 THEN NULL ELSE ts END AS seen FROM events)""",
)
def _(t: Tables):
    events = t.events.selectExpr(
        "event_id", "CASE WHEN event_id % 6 = 1 THEN NULL ELSE ts END AS seen"
    )
    return clean.clean(events, False, "median", ["seen"], ["event_id"]).df


@query(
    "row_number_in_hot_groups",
    """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank,
           count(*) OVER (PARTITION BY event_type) AS rank_total FROM events""",
)
def _(t: Tables):
    ranked = ordering.with_row_number(
        t.events.select("event_id", "ts", "event_type"), [F.col("ts"), F.col("event_id")], ["event_type"]
    )
    return ranked.select("event_id", "rank", "rank_total")


@query(
    "interpolate",
    """WITH d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, avg(value) AS v
               FROM (SELECT event_type, ts, CASE WHEN day(ts) % 5 NOT IN (0, 1) THEN value END AS value
                     FROM events) GROUP BY 1, 2),
         e AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events),
         c AS (SELECT event_type, a, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day
               FROM (SELECT DISTINCT event_type FROM events), e),
         j AS (SELECT c.event_type, datediff('day', a, c.day) AS step, v
               FROM c LEFT JOIN d ON c.event_type = d.event_type AND c.day = d.day),
         n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER b AS s0,
                      last_value(v IGNORE NULLS) OVER b AS v0,
                      first_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER a AS s1,
                      first_value(v IGNORE NULLS) OVER a AS v1 FROM j
               WINDOW b AS (PARTITION BY event_type ORDER BY step
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      a AS (PARTITION BY event_type ORDER BY step
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_type, CAST(step AS BIGINT) AS step,
           round(CASE WHEN v IS NOT NULL THEN v WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0
                ELSE v0 + (v1 - v0) * (step - s0) / (s1 - s0) END, 4) AS value FROM n""",
)
def _(t: Tables):
    ends = t.events.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    start, last = (F.lit(end) for end in ends)
    known = F.when(~F.pmod(F.dayofmonth("ts"), F.lit(5)).isin(0, 1), F.col("value"))
    days = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        F.avg(known).alias("value")
    )
    calendar = t.events.select("event_type").distinct().select(
        "event_type", F.explode(F.sequence(start, last)).alias("day")
    )
    steps = calendar.join(days, ["event_type", "day"], "left").select(
        "event_type", F.date_diff("day", start).cast("long").alias("step"), "value"
    )
    return rounded(interpolate(steps, "value", "step", ["event_type"]), 4)


# Sources and sinks -----------------------------------------------------


def _scratch(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


# Quotes, commas and line breaks in names, and every fourth balance missing.
_AWKWARD = """(SELECT c_custkey, CASE c_custkey % 3
        WHEN 0 THEN c_name || ' "the first" one' WHEN 1 THEN c_name || ', x' || chr(10) || 'y'
        ELSE c_name END AS c_name, c_nationkey,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def _awkward_csv(t: Tables) -> str:
    path = _scratch(t)
    t.customer.selectExpr(
        "c_custkey",
        """CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' "the first" one')
        WHEN 1 THEN concat(c_name, ', x', chr(10), 'y') ELSE c_name END AS c_name""",
        "c_nationkey",
        "CASE WHEN c_custkey % 4 = 0 THEN 'NA' ELSE CAST(c_acctbal AS STRING) END AS c_acctbal",
        "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE c_mktsegment END AS c_mktsegment",
    ).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "csv_scan",
    f"""SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment
    FROM {_AWKWARD}""",
)
def _(t: Tables):
    return rounded(files.read_csv(t.spark, _awkward_csv(t), t.customer.schema))


@query(
    "csv_scan_inferred",
    f"""SELECT c_mktsegment, sum(c_nationkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS balance,
           count(c_acctbal) AS balances, sum(length(c_name))::BIGINT AS letters
    FROM {_AWKWARD} GROUP BY 1""",
)
def _(t: Tables):
    read = files.read_csv(t.spark, _awkward_csv(t))
    return rounded(
        read.groupBy("c_mktsegment").agg(
            F.sum("c_nationkey").alias("keys"),
            F.sum("c_acctbal").alias("balance"),
            F.count("c_acctbal").alias("balances"),
            F.sum(F.length("c_name")).alias("letters"),
        )
    )


@query(
    "dataset_versions",
    f"""SELECT 'raw' AS version, count(*) AS rows FROM {COPIES}
    UNION ALL SELECT 'clean', count(*) FROM (SELECT DISTINCT * FROM {COPIES})
    UNION ALL SELECT 'preferred', count(*) FROM (SELECT DISTINCT * FROM {COPIES})""",
)
def _(t: Tables):
    store = files.DatasetStore(t.spark, _scratch(t))
    store.save("lines", few_columns(t))
    store.save("lines", clean.drop_duplicate_rows(store.load("lines")), cleaned=True)
    versions = {
        "raw": store.load("lines", cleaned=False),
        "clean": t.spark.read.parquet(store.path("lines", True)),
        "preferred": store.load("lines"),
    }
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(v).alias("version"), "rows")
        for v, df in versions.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(
    "ingest",
    f"""SELECT strftime(CAST(TRY_CAST(shipped AS TIMESTAMP) AS TIMESTAMP), '%Y') AS year,
           count(*) AS rows, count(quantity) AS quantities FROM {TEXT} GROUP BY 1""",
)
def _(t: Tables):
    untrimmed = text_lines(t).withColumnRenamed("shipped", " shipped ")
    found = files.normalised(untrimmed)
    return found.groupBy(F.date_format("shipped", "yyyy").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("quantity").alias("quantities")
    )


@query(
    "import_profile",
    f"""SELECT 'quantity' AS name, 'categorical' AS inferred_type,
           count(*) - count(quantity) AS missing_count, count(DISTINCT quantity) AS unique_count
        FROM {TEXT}
    UNION ALL SELECT 'shipped', 'datetime', count(*) - count(TRY_CAST(shipped AS TIMESTAMP)),
           count(DISTINCT TRY_CAST(shipped AS TIMESTAMP)) FROM {TEXT}
    UNION ALL SELECT 'l_returnflag', 'categorical', 0, count(DISTINCT l_returnflag) FROM {TEXT}""",
)
def _(t: Tables):
    store = files.DatasetStore(t.spark, _scratch(t))
    found = files.import_table(store, "lines", text_lines(t), "files", "lineitem")
    return found.to_df(t.spark).select("name", "inferred_type", "missing_count", "unique_count")


@query(
    "flatten_json_column",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t: Tables):
    return nested.flatten_json_column(t.events, "props", keep=["event_id"])


@query(
    "read_nested_json",
    """SELECT o_orderkey AS "order.key", o_totalprice AS "order.price", o_orderstatus AS status,
           CAST(1 AS BIGINT) AS tags FROM orders""",
)
def _(t: Tables):
    path = _scratch(t)
    item = F.struct(
        F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")).alias(
            "order"
        ),
        F.col("o_orderstatus").alias("status"),
        F.array("o_orderpriority").alias("tags"),
    )
    t.orders.select(F.struct(F.array(item).alias("items")).alias("data")).write.json(path)
    flat = nested.read_json(t.spark, path, "data.items")
    return flat.withColumn("tags", F.size("tags").cast("long"))


@query(
    "report_data",
    f"""SELECT o_orderkey, o_custkey, coalesce(status, '') AS status FROM {ORDERS}
    ORDER BY o_orderkey LIMIT 5000""",
)
def _(t: Tables):
    path = _scratch(t)
    found = reports.report_tables(
        gappy_orders(t).select("o_orderkey", "o_custkey", "status"), order_by=["o_orderkey"]
    )
    reports.write_report(found, path)
    return t.spark.read.parquet(f"{path}/data").na.fill("")


@query(
    "report_statistics",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
            round(quantile_cont({c}, 0.5), 4) AS q50 FROM {ORDERS}"""
        for c in ("o_orderkey", "o_custkey", "price")
    ),
)
def _(t: Tables):
    path = _scratch(t)
    reports.write_report(reports.report_tables(gappy_orders(t)), path)
    kept = t.spark.read.parquet(f"{path}/statistics")
    return rounded(kept.select("column", "count", "mean", "q50"), 4)
