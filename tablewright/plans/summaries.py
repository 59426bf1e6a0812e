"""Queries on aggregates, profiles, statistics and charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import charts, profile, quantiles, query as ask, stats
from tablewright.plans.inputs import (
    SQL,
    few_columns,
    gappy_lines,
    gappy_orders,
    patchy_months,
    skewed_lines,
    text_lines,
)
from tablewright.plans.registry import Tables, query, rounded

LINES, ORDERS, TEXT = SQL["gappy_lines"], SQL["gappy_orders"], SQL["text_lines"]
COPIES, TAIL, PATCHY = SQL["few_columns"], SQL["skewed_lines"], SQL["patchy_months"]

# Aggregates ------------------------------------------------------------

_FOLDS = {
    "sum": "sum(x)",
    "mean": "avg(x)",
    "median": "quantile_cont(x, 0.5)",
    "min": "min(x)",
    "max": "max(x)",
    "count": "count(x)",
}


def _aggregates_sql(source: str, value: str, metric: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, '{name}' AS aggregation, "
        f"round(CAST({fold} AS DOUBLE), 3) AS value, count(x) AS valid_rows, "
        f"count(*) - count(x) AS excluded_rows FROM (SELECT {value} AS x FROM {source})"
        for name, fold in _FOLDS.items()
    )


def _aggregates(df: DataFrame, metric: str, in_memory_rows: int) -> DataFrame:
    return rounded(ask.aggregates(df, metric, _FOLDS, in_memory_rows), 3)


@query("aggregate", _aggregates_sql(LINES, "price", "price"))
def _(t: Tables):
    return _aggregates(gappy_lines(t), "price", ask.IN_MEMORY_ROWS)


@query("aggregate_text_numbers", _aggregates_sql(TEXT, "TRY_CAST(quantity AS DOUBLE)", "quantity"))
def _(t: Tables):
    return _aggregates(text_lines(t), "quantity", 0)


def _group_sql(source: str, key: str, fold: str, limit: int, metric: str) -> str:
    return f"""
        SELECT coalesce(CAST(k AS VARCHAR), 'Missing') AS dimension_value, round(v, 3) AS value
        FROM (SELECT {key} AS k, CAST({fold} AS DOUBLE) AS v FROM {source}
              WHERE {metric} IS NOT NULL GROUP BY 1)
        ORDER BY abs(v) DESC, CAST(k AS VARCHAR) NULLS LAST LIMIT {limit}"""


@query("group_by_sum", _group_sql(LINES, "flag", "sum(price)", 20, "price"))
def _(t: Tables):
    return rounded(ask.group_by(gappy_lines(t), "price", "flag"), 3)


@query("group_by_count_many_groups", _group_sql("orders", "o_custkey", "count(*)", 20, "o_custkey"))
def _(t: Tables):
    return rounded(ask.group_by(t.orders, "o_totalprice", "o_custkey", "count"), 3)


@query("group_by_mean", _group_sql(LINES, "status", "avg(quantity)", 20, "quantity"))
def _(t: Tables):
    return rounded(ask.group_by(gappy_lines(t), "quantity", "status", "mean"), 3)


@query("group_by_max", _group_sql("customer", "c_nationkey", "max(c_acctbal)", 5, "c_acctbal"))
def _(t: Tables):
    return rounded(ask.group_by(t.customer, "c_acctbal", "c_nationkey", "max", limit=5), 3)


_MEDIANS = _group_sql(LINES, "flag", "quantile_cont(price, 0.5)", 20, "price")


@query("group_by_median", _MEDIANS)
def _(t: Tables):
    return rounded(ask.group_by(gappy_lines(t), "price", "flag", "median"), 3)


@query("group_by_median_bracketed", _MEDIANS)
def _(t: Tables):
    return rounded(
        ask.group_by(gappy_lines(t), "price", "flag", "median", in_memory_rows=0), 3
    )


_HOT = "CASE WHEN l_orderkey % 100 = 0 THEN NULL WHEN l_orderkey % 10 < 9 THEN 'hot' ELSE l_returnflag END"


@query(
    "group_quantiles_one_hot",
    f"""SELECT {_HOT} AS k, count(x) AS rows, round(quantile_cont(x, 0), 4) AS q0,
           round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS q2,
           round(quantile_cont(x, 0.99), 4) AS q3, round(quantile_cont(x, 1), 4) AS q4
    FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_extendedprice - 30000) / 3 END AS x FROM lineitem)
    WHERE x IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    rows = t.lineitem.selectExpr(
        f"{_HOT} AS k", "CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_extendedprice - 30000) / 3 END AS x"
    )
    found = quantiles.group_quantiles(rows, ["k"], "x", [0.0, 0.25, 0.5, 0.99, 1.0], in_memory_rows=500)
    return rounded(found, 4)


_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_LABEL = {
    "D": "strftime(k, '%Y-%m-%d')",
    "W": "strftime(k, '%Y-%m-%d') || '/' || strftime(k + INTERVAL 6 DAY, '%Y-%m-%d')",
    "M": "strftime(k, '%Y-%m')",
    "Q": "strftime(k, '%Y') || 'Q' || quarter(k)",
    "Y": "strftime(k, '%Y')",
}


def _trend_sql(source: str, ts: str, value: str, period: str, fold: str) -> str:
    return f"""
        SELECT {_LABEL[period]} AS period, round(v, 3) AS value
        FROM (SELECT date_trunc('{_UNIT[period]}', d) AS k, CAST({fold} AS DOUBLE) AS v
              FROM (SELECT {ts} AS d, {value} AS x FROM {source})
              WHERE d IS NOT NULL AND x IS NOT NULL GROUP BY 1)"""


@query("trend_month", _trend_sql("lineitem", "l_shipdate", "l_extendedprice", "M", "sum(x)"))
def _(t: Tables):
    return rounded(ask.trend(t.lineitem, "l_shipdate", "l_extendedprice"), 3)


@query("trend_day_mean", _trend_sql("events", "ts", "value", "D", "avg(x)"))
def _(t: Tables):
    return rounded(ask.trend(t.events, "ts", "value", "D", "mean"), 3)


@query("trend_week_max", _trend_sql(LINES, "shipdate", "quantity", "W", "max(x)"))
def _(t: Tables):
    return rounded(ask.trend(gappy_lines(t), "shipdate", "quantity", "W", "max"), 3)


@query("trend_quarter_median", _trend_sql(LINES, "shipdate", "price", "Q", "quantile_cont(x, 0.5)"))
def _(t: Tables):
    return rounded(ask.trend(gappy_lines(t), "shipdate", "price", "Q", "median"), 3)


@query("trend_year_count", _trend_sql("orders", "o_orderdate", "o_totalprice", "Y", "count(x)"))
def _(t: Tables):
    return rounded(ask.trend(t.orders, "o_orderdate", "o_totalprice", "Y", "count"), 3)


@query(
    "trend_text_dates",
    _trend_sql(
        TEXT, "TRY_CAST(shipped AS TIMESTAMP)", "TRY_CAST(quantity AS DOUBLE)", "M", "sum(x)"
    ),
)
def _(t: Tables):
    return rounded(ask.trend(text_lines(t), "shipped", "quantity"), 3)


_MONTH_TOTALS = f"""
    SELECT date_trunc('month', orderdate) AS k, sum(price) AS v FROM {PATCHY}
    WHERE orderdate IS NOT NULL GROUP BY 1"""


@query(
    "filled_trend",
    f"""
    WITH m AS ({_MONTH_TOTALS}),
         r AS (SELECT min(k) AS a, max(k) AS b FROM m),
         c AS (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS k FROM r)
    SELECT strftime(c.k, '%Y-%m') AS period, round(coalesce(v, 0.0), 2) AS value
    FROM c LEFT JOIN m ON c.k = m.k""",
)
def _(t: Tables):
    return rounded(ask.filled_trend(patchy_months(t), "orderdate", "price"))


@query(
    "trend_direction",
    f"""
    WITH m AS ({_MONTH_TOTALS})
    SELECT round(a, 2) AS first_value, round(b, 2) AS last_value,
           CASE WHEN b >= a THEN 'increased' ELSE 'decreased' END AS direction
    FROM (SELECT arg_min(v, k) AS a, arg_max(v, k) AS b FROM m)""",
)
def _(t: Tables):
    return rounded(ask.trend_direction(patchy_months(t), "orderdate", "price"))


def _ranked_sql(order: str) -> str:
    return f"""
        SELECT flag AS dimension_value, round(coalesce(sum(quantity), 0.0), 2) AS value FROM {LINES}
        WHERE flag IS NOT NULL GROUP BY 1 ORDER BY 2 {order}, 1 LIMIT 2"""


@query("ranked_groups_top", _ranked_sql("DESC"))
def _(t: Tables):
    return rounded(ask.ranked_groups(gappy_lines(t), "quantity", "flag", 2))


@query("ranked_groups_bottom", _ranked_sql("ASC"))
def _(t: Tables):
    return rounded(ask.ranked_groups(gappy_lines(t), "quantity", "flag", 2, bottom=True))


@query(
    "ranked_values",
    """
    SELECT * FROM (SELECT 'top' AS side, l_extendedprice AS value FROM lineitem
                   ORDER BY 2 DESC LIMIT 5)
    UNION ALL
    SELECT * FROM (SELECT 'bottom' AS side, l_extendedprice AS value FROM lineitem
                   ORDER BY 2 LIMIT 5)""",
)
def _(t: Tables):
    sides = {"top": False, "bottom": True}
    return reduce(
        DataFrame.unionByName,
        [
            ask.ranked_values(t.lineitem, "l_extendedprice", 5, bottom).select(
                F.lit(side).alias("side"), "value"
            )
            for side, bottom in sides.items()
        ],
    )


@query(
    "segment_values",
    f"SELECT DISTINCT priority AS segment_value FROM {ORDERS} WHERE trim(priority) <> ''",
)
def _(t: Tables):
    return ask.segment_values(gappy_orders(t), "priority")


@query(
    "preview",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           coalesce(status, '') AS status, coalesce(priority, '') AS priority
    FROM {ORDERS} AS o ORDER BY o.o_orderkey LIMIT 50""",
)
def _(t: Tables):
    table = gappy_orders(t).select("o_orderkey", "o_custkey", "status", "priority")
    return ask.preview(table, 50, ["o_orderkey"])


# Profile ---------------------------------------------------------------


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    """``columns`` maps a name to its kind: int, double, time or text."""
    rule = {
        "int": "CASE WHEN u <= 15 AND u * 1.0 / n < 0.05 THEN 'categorical' ELSE 'numerical' END",
        "double": "'numerical'",
        "time": "'datetime'",
        "text": "CASE WHEN u <= greatest(20, CAST(floor(0.05 * n) AS BIGINT)) AND l < 50 "
        "THEN 'categorical' ELSE 'text' END",
    }
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS name, {rule[kind]} AS inferred_type, n - c AS missing_count,
            round((n - c) * 100.0 / n, 2) AS missing_pct, u AS unique_count
            FROM (SELECT count(*) AS n, count({name}) AS c, count(DISTINCT {name}) AS u,
                  {f'avg(length({name}))' if kind == 'text' else '0'} AS l FROM {source})"""
        for name, kind in columns.items()
    )


_PROFILED = ["name", "inferred_type", "missing_count", "missing_pct", "unique_count"]


@query(
    "profile_columns",
    _profile_sql(
        ORDERS,
        {
            "o_orderkey": "int",
            "o_custkey": "int",
            "status": "text",
            "price": "double",
            "orderdate": "time",
            "priority": "text",
            "code": "int",
        },
    ),
)
def _(t: Tables):
    return profile.profile(gappy_orders(t)).to_df(t.spark).select(*_PROFILED)


@query(
    "profile_documents",
    _profile_sql(
        "documents",
        {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"},
    ),
)
def _(t: Tables):
    table = t.documents.select("doc_id", "text", "lang", "source", "n_chars")
    return profile.profile(table).to_df(t.spark).select(*_PROFILED)


@query(
    "distinct_samples",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS unique_count,
            (SELECT string_agg(v, ',' ORDER BY v)
             FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {LINES} WHERE {c} IS NOT NULL
                   ORDER BY 1 LIMIT 5)) AS samples
            FROM (SELECT DISTINCT {c} FROM {LINES} WHERE {c} IS NOT NULL)"""
        for c in ("flag", "status")
    ),
)
def _(t: Tables):
    return profile.distinct_counts(gappy_lines(t), ["flag", "status"]).select(
        "column", "unique_count", F.array_join("sample_values", ",").alias("samples")
    )


_LINE_COLUMNS = [
    "l_orderkey",
    "l_linenumber",
    "quantity",
    "price",
    "discount",
    "flag",
    "status",
    "shipdate",
]


def _missing_union(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        f"count(*) AS total_rows FROM {source}"
        for i, c in enumerate(columns)
    )


@query("missing_by_column", _missing_union(LINES, _LINE_COLUMNS))
def _(t: Tables):
    return profile.missing_by_column(gappy_lines(t))


@query(
    "most_missing",
    f"""SELECT "column", missing_count FROM ({_missing_union(LINES, _LINE_COLUMNS)})
    WHERE missing_count > 0 ORDER BY missing_count DESC, position LIMIT 3""",
)
def _(t: Tables):
    return profile.most_missing(gappy_lines(t), 3)


@query(
    "completeness",
    f"""SELECT m AS missing_cells, n AS total_cells, c AS completeness,
        CASE WHEN c >= 95 THEN 'Excellent' WHEN c >= 90 THEN 'Good'
             WHEN c >= 75 THEN 'Moderate' ELSE 'Needs Attention' END AS assessment
    FROM (SELECT CAST(sum(missing_count) AS BIGINT) AS m, CAST(sum(total_rows) AS BIGINT) AS n,
                 round(100.0 - round(sum(missing_count) * 100.0 / sum(total_rows), 2), 2) AS c
          FROM ({_missing_union(LINES, _LINE_COLUMNS)}))""",
)
def _(t: Tables):
    return rounded(profile.completeness(gappy_lines(t)))


_DUPLICATES = f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {COPIES})) AS d, count(*) AS n FROM {COPIES})"


@query("duplicate_count", f"SELECT d AS duplicate_rows, n AS total_rows FROM {_DUPLICATES}")
def _(t: Tables):
    return profile.duplicate_count(few_columns(t))


@query(
    "dataset_summary",
    f"""SELECT count(*) AS row_count, 7 AS column_count,
        'o_orderkey,o_custkey,price,code' AS numeric_columns,
        'status,priority' AS categorical_columns,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {ORDERS})) AS duplicate_rows,
        2 * count(*) - count(status) - count(priority) AS missing_cells,
        count(*) - count(status) AS missing_status,
        count(*) - count(priority) AS missing_priority FROM {ORDERS}""",
)
def _(t: Tables):
    gaps = F.col("missing_by_column")
    return profile.dataset_summary(gappy_orders(t)).select(
        "row_count",
        "column_count",
        F.array_join("numeric_columns", ",").alias("numeric_columns"),
        F.array_join("categorical_columns", ",").alias("categorical_columns"),
        "duplicate_rows",
        "missing_cells",
        gaps["status"].alias("missing_status"),
        gaps["priority"].alias("missing_priority"),
    )


@query(
    "report_summary",
    f"""WITH p AS ({_profile_sql(COPIES, {"l_returnflag": "text", "l_linestatus": "text",
                                          "l_quantity": "double", "l_discount": "double"})}),
         d AS {_DUPLICATES}
    SELECT 'Total Rows' AS metric, CAST(n AS DOUBLE) AS value FROM d
    UNION ALL SELECT 'Total Columns', 4.0
    UNION ALL SELECT 'Duplicate Rows', CAST(d AS DOUBLE) FROM d
    UNION ALL SELECT 'Missing Cells', CAST(sum(missing_count) AS DOUBLE) FROM p
    UNION ALL SELECT 'Missing Percentage', CAST(avg(missing_pct) AS DOUBLE) FROM p
    UNION ALL SELECT 'Numerical Columns',
        CAST(count(*) FILTER (inferred_type = 'numerical') AS DOUBLE) FROM p
    UNION ALL SELECT 'Categorical Columns',
        CAST(count(*) FILTER (inferred_type = 'categorical') AS DOUBLE) FROM p
    UNION ALL SELECT 'Datetime Columns', 0.0
    UNION ALL SELECT 'Text Columns',
        CAST(count(*) FILTER (inferred_type = 'text') AS DOUBLE) FROM p""",
)
def _(t: Tables):
    return profile.profile(few_columns(t)).summary_df(t.spark)


@query(
    "cleaning_suggestions",
    f"""WITH g AS ({_missing_union(LINES, _LINE_COLUMNS)}),
         q AS (SELECT "column", round(missing_count * 100.0 / total_rows, 2) AS pct FROM g)
    SELECT "column",
           CASE WHEN "column" IN ('quantity', 'price') THEN 'Impute with median (robust to outliers).'
                WHEN "column" = 'flag' THEN 'Impute with the most frequent category (mode).'
                ELSE 'Forward-fill or drop rows, depending on whether the series is sequential.'
           END AS suggestion
    FROM q WHERE pct > 0""",
)
def _(t: Tables):
    found = profile.profile(gappy_lines(t))
    return profile.cleaning_suggestions(found, t.spark).select("column", "suggestion")


# Statistics ------------------------------------------------------------

_NUMBERS = ["quantity", "price", "discount"]


def _describe_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
            round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
            round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max,
            round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis
            FROM {source}"""
        for c in columns
    )


@query("describe", _describe_sql(LINES, _NUMBERS))
def _(t: Tables):
    return rounded(stats.describe(gappy_lines(t), _NUMBERS), 4)


@query("describe_bracketed", _describe_sql(LINES, _NUMBERS))
def _(t: Tables):
    return rounded(stats.describe(gappy_lines(t), _NUMBERS, in_memory_rows=1000), 4)


@query(
    "box_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min({c}), 4) AS min,
            round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
            round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM {LINES}"""
        for c in _NUMBERS
    ),
)
def _(t: Tables):
    return rounded(stats.box_summary(gappy_lines(t), _NUMBERS), 4)


_WIDE = {
    f"x{i}": f"CASE WHEN l_orderkey % {i + 5} = 0 THEN NULL ELSE "
    + ("7.5" if i == 4 else f"sin(l_orderkey * {i + 1}) * {i} + l_{c}")
    + " END"
    for i, c in enumerate(("quantity", "extendedprice", "discount", "tax") * 4)
}
_WIDE_TABLE = f"(SELECT {', '.join(f'{x} AS {c}' for c, x in _WIDE.items())} FROM lineitem)"


@query(
    "correlations_wide",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) "
        f"THEN round(corr({a}, {b}), 6) END AS r FROM {_WIDE_TABLE}"
        for i, a in enumerate(_WIDE)
        for b in list(_WIDE)[i + 1 :]
    ),
)
def _(t: Tables):
    return rounded(stats.correlations(t.lineitem.selectExpr(*(f"{x} AS {c}" for c, x in _WIDE.items())), list(_WIDE)), 6)


_TAIL_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "tail"]
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM {TAIL}"
    for i, a in enumerate(_TAIL_COLUMNS)
    for b in _TAIL_COLUMNS[i + 1 :]
)


@query(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM {LINES}"
        for i, a in enumerate(_NUMBERS)
        for b in _NUMBERS[i + 1 :]
    ),
)
def _(t: Tables):
    return rounded(stats.correlations(gappy_lines(t), _NUMBERS), 6)


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", "
        + ", ".join(
            f"round(corr({a}, {b}), 3) AS {b}" if a != b else f"1.0::DOUBLE AS {b}"
            for b in _TAIL_COLUMNS
        )
        + f" FROM {TAIL}"
        for a in _TAIL_COLUMNS
    ),
)
def _(t: Tables):
    return stats.correlation_matrix(skewed_lines(t), _TAIL_COLUMNS)


@query(
    "strongest_pairs",
    f"""SELECT column_a, column_b, round(r, 6) AS r,
        CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
             ELSE 'weak' END AS strength,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
    FROM ({_PAIRS}) ORDER BY abs(r) DESC, column_a, column_b LIMIT 3""",
)
def _(t: Tables):
    return rounded(stats.strongest_pairs(skewed_lines(t), _TAIL_COLUMNS, 3), 6)


_OUTLIERS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS n,
        count({c}) AS valid, any_value(lo) AS lo, any_value(hi) AS hi
        FROM {TAIL}, (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi
             FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b
                   FROM {TAIL}))"""
    for c in _TAIL_COLUMNS
)
_IQR = f"""
    SELECT "column", n AS count, round(n * 100.0 / valid, 2) AS pct,
           round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound,
           CASE WHEN n * 1.0 / valid < 0.1 THEN 'Cap values at the IQR bounds (winsorize)'
                ELSE 'Investigate — a large share of points are flagged; the distribution may be genuinely skewed'
           END AS treatment_suggestion
    FROM ({_OUTLIERS})"""


@query("iqr_outliers", _IQR)
def _(t: Tables):
    found = stats.iqr_outliers(skewed_lines(t), _TAIL_COLUMNS)
    return rounded(found.drop("sample_values"))


@query("iqr_outliers_bracketed", _IQR)
def _(t: Tables):
    found = stats.iqr_outliers(skewed_lines(t), _TAIL_COLUMNS, in_memory_rows=1000)
    return rounded(found.drop("sample_values"))


@query(
    "outlier_samples",
    f"""SELECT "column", x AS value FROM (
          SELECT 'tail' AS "column", round(tail, 2) AS x FROM {TAIL},
            (SELECT b + 1.5 * (b - a) AS hi, a - 1.5 * (b - a) AS lo
             FROM (SELECT quantile_cont(tail, 0.25) AS a, quantile_cont(tail, 0.75) AS b FROM {TAIL}))
          WHERE tail > hi OR tail < lo ORDER BY tail LIMIT 10)""",
)
def _(t: Tables):
    found = stats.iqr_outliers(skewed_lines(t), ["tail"])
    return rounded(found.select("column", F.explode("sample_values").alias("value")))


@query(
    "outlier_total", f"SELECT CAST(sum(n) AS BIGINT) AS total_outliers FROM ({_OUTLIERS})"
)
def _(t: Tables):
    return stats.outlier_total(skewed_lines(t), _TAIL_COLUMNS)


@query(
    "flagged_columns",
    f"""SELECT "column", n AS count, round(n * 100.0 / valid, 2) AS pct
    FROM ({_OUTLIERS}) WHERE n > 0""",
)
def _(t: Tables):
    return stats.flagged_columns(skewed_lines(t), _TAIL_COLUMNS)


# Charts ----------------------------------------------------------------


def _histogram_sql(column: str) -> str:
    # Values are moved to the bin whose edges hold them, as floor alone can miss by one.
    return f"""
        SELECT '{column}' AS "column", CAST(i AS INT) AS bin,
               round(lo + i * (hi - lo) / 20, 3) AS bin_start,
               round(lo + (i + 1) * (hi - lo) / 20, 3) AS bin_end,
               count(b) AS count
        FROM (SELECT unnest(range(20)) AS i), (SELECT min({column}) AS lo, max({column}) AS hi
              FROM {TAIL}) LEFT JOIN (
          SELECT CASE WHEN x < lo + g * s THEN g - 1
                      WHEN g < 19 AND x >= lo + (g + 1) * s THEN g + 1 ELSE g END AS b
          FROM (SELECT x, lo, s, least(CAST(floor((x - lo) / s) AS BIGINT), 19) AS g
                FROM (SELECT {column} AS x FROM {TAIL} WHERE {column} IS NOT NULL),
                     (SELECT min({column}) AS lo, (max({column}) - min({column})) / 20 AS s
                      FROM {TAIL}))) ON b = i
        GROUP BY i, lo, hi"""


@query("histograms", " UNION ALL ".join(_histogram_sql(c) for c in _TAIL_COLUMNS))
def _(t: Tables):
    return rounded(charts.histograms(skewed_lines(t), _TAIL_COLUMNS), 3)


@query(
    "category_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", label, count,
            CAST(row_number() OVER (ORDER BY count DESC, label) AS INT) AS rank
            FROM (SELECT CAST({c} AS VARCHAR) AS label, count(*) AS count FROM part
                  GROUP BY 1) QUALIFY rank <= 12"""
        for c in ("p_brand", "p_type", "p_size")
    ),
)
def _(t: Tables):
    return charts.category_counts(t.part, ["p_brand", "p_type", "p_size"])


@query(
    "scatter_sample",
    """SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
    ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                           CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '42'))
    LIMIT 2000""",
)
def _(t: Tables):
    return charts.scatter_sample(
        t.lineitem,
        "l_quantity",
        "l_extendedprice",
        key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


@query(
    "thinned_line",
    """SELECT ts AS x, value AS y FROM (
         SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n
         FROM events)
    WHERE r % CASE WHEN n > 2000 THEN n // 2000 ELSE 1 END = 0""",
)
def _(t: Tables):
    return charts.thinned_line(t.events, "ts", "value", order_by=["event_id"])
