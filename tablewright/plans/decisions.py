"""Queries on root causes, recommendations, scenarios and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import insights, recommend, whatif
from tablewright.operators.rootcause import (
    RootCause,
    analyze_period_change,
    root_cause,
    top_by_contribution,
)
from tablewright.plans.inputs import (
    SQL,
    few_columns,
    gappy_lines,
    gappy_orders,
    skewed_lines,
)
from tablewright.plans.registry import Tables, query, rounded, run_operator

LINES, ORDERS, COPIES = SQL["gappy_lines"], SQL["gappy_orders"], SQL["few_columns"]

# Root cause ------------------------------------------------------------

_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_LABEL = {
    "D": "strftime({k}, '%Y-%m-%d')",
    "W": "strftime({k}, '%Y-%m-%d') || '/' || strftime({k} + INTERVAL 6 DAY, '%Y-%m-%d')",
    "M": "strftime({k}, '%Y-%m')",
    "Q": "strftime({k}, '%Y') || 'Q' || quarter({k})",
    "Y": "strftime({k}, '%Y')",
}
_TIME_TEXT = (
    "CASE WHEN {x} = date_trunc('day', {x}) THEN strftime({x}, '%Y-%m-%d') "
    "ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END"
)


def _window_sql(source: str, ts: str, metric: str, period: str, mode: str) -> str:
    """CTEs: rows ``w`` of both windows, their bounds ``b`` and totals ``t``."""
    unit = _UNIT[period]
    step = "INTERVAL 3 MONTH" if period == "Q" else f"INTERVAL 1 {unit}"
    if period == "D":
        complete = (
            "NOT intraday OR last_ts >= cur + INTERVAL 1 DAY - INTERVAL 1 SECOND"
        )
        cut = "prev + (last_ts - cur) + INTERVAL 1 MICROSECOND"
    else:
        complete = f"date_trunc('day', last_ts) >= cur + {step} - INTERVAL 1 DAY"
        cut = "prev + (date_trunc('day', last_ts) - cur) + INTERVAL 1 DAY"
    cut_off = f"least({cut}, prev + {step})" if mode == "comparable" else f"prev + {step}"
    return f"""
    WITH r AS (SELECT *, {ts} AS ts, {metric} AS m FROM {source}
               WHERE {ts} IS NOT NULL AND {metric} IS NOT NULL),
         k AS (SELECT DISTINCT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS k FROM r
               ORDER BY 1 DESC LIMIT 2),
         p AS (SELECT min(k) AS prev, max(k) AS cur FROM k),
         q AS (SELECT prev, cur, max(ts) AS last_ts,
                      bool_or(ts <> date_trunc('day', ts)) AS intraday
               FROM r, p WHERE ts >= cur GROUP BY 1, 2),
         b AS (SELECT *, ({complete}) AS complete,
                      CASE WHEN {complete} THEN prev + {step} ELSE {cut_off} END AS prev_to FROM q),
         w AS (SELECT r.*, ts >= cur AS is_cur FROM r, b
               WHERE ts >= cur OR (ts >= prev AND ts < prev_to)),
         t AS (SELECT coalesce(sum(m) FILTER (NOT is_cur), 0.0) AS v0,
                      coalesce(sum(m) FILTER (is_cur), 0.0) AS v1,
                      min(ts) FILTER (NOT is_cur) AS a0, max(ts) FILTER (NOT is_cur) AS a1,
                      min(ts) FILTER (is_cur) AS c0, max(ts) FILTER (is_cur) AS c1 FROM w)"""


def _comparison_sql(*args: str) -> str:
    metric, period = args[2], args[3]
    label = _LABEL[period]
    return f"""{_window_sql(*args)}
    SELECT '{metric}' AS metric, {label.format(k='prev')} AS previous_period,
           {label.format(k='cur')} AS current_period, round(v0, 2) AS previous_value,
           round(v1, 2) AS current_value, round(v1 - v0, 2) AS absolute_change,
           round((v1 - v0) / nullif(abs(v0), 0) * 100, 2) AS percentage_change,
           CASE WHEN v1 > v0 THEN 'increase' WHEN v1 < v0 THEN 'decrease' ELSE 'no_change' END
             AS direction
    FROM t, b"""


def _quality_sql(*args: str) -> str:
    mode = args[4]
    text = {n: _TIME_TEXT.format(x=n) for n in ("a0", "a1", "c0", "c1")}
    return f"""{_window_sql(*args)}
    SELECT '{mode}' AS comparison_mode, complete AS current_period_complete,
           CAST(day(c1) AS INT) AS current_period_last_day,
           {text['c1']} AS current_period_last_date,
           ('{mode}' = 'comparable' AND NOT complete) AS warned,
           {text['a0']} AS previous_start, {text['a1']} AS previous_end,
           {text['c0']} AS current_start, {text['c1']} AS current_end FROM t, b"""


def _contributors_sql(args: tuple[str, ...], dimensions: list[str], tail: str = "") -> str:
    per_value = " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS v,
            coalesce(sum(m) FILTER (NOT is_cur), 0.0) AS x0,
            coalesce(sum(m) FILTER (is_cur), 0.0) AS x1 FROM w GROUP BY 2"""
        for d in dimensions
    )
    return f"""{_window_sql(*args)},
         g AS (SELECT *, x1 - x0 AS ch FROM ({per_value}))
    SELECT dimension, coalesce(v, 'Missing') AS value, round(x0, 2) AS previous_value,
           round(x1, 2) AS current_value, round(ch, 2) AS change,
           round(CASE WHEN v1 = v0 THEN 0.0 ELSE ch / (v1 - v0) * 100 END, 2) AS contribution_pct,
           CASE WHEN ch > 0 THEN 'positive' WHEN ch < 0 THEN 'negative' ELSE 'neutral' END AS impact
    FROM g, t {tail}"""


_FULL = (ORDERS, "orderdate", "price", "M", "full")
_COMPARABLE = (ORDERS, "orderdate", "price", "M", "comparable")
_DIMENSIONS = ["status", "priority", "code"]


def _orders_cause(t: Tables, mode: str, period: str = "M") -> RootCause:
    return analyze_period_change(
        gappy_orders(t), "orderdate", "price", [*_DIMENSIONS, "no_such_column"], period, mode
    )


def _shown_quality(cause: RootCause) -> DataFrame:
    return cause.quality.select(
        *[c for c in cause.quality.columns if c != "warning"],
        F.col("warning").isNotNull().alias("warned"),
    )


@query("root_cause_comparison", _comparison_sql(*_FULL))
def _(t: Tables):
    return rounded(_orders_cause(t, "full").comparison)


@query("root_cause_quality", _quality_sql(*_FULL))
def _(t: Tables):
    return _shown_quality(_orders_cause(t, "full"))


@query("root_cause_contributors", _contributors_sql(_FULL, _DIMENSIONS))
def _(t: Tables):
    return rounded(_orders_cause(t, "full").contributors)


@query(
    "root_cause_top_contributors",
    _contributors_sql(_FULL, _DIMENSIONS, "ORDER BY abs(ch) DESC, dimension, v LIMIT 5"),
)
def _(t: Tables):
    return rounded(_orders_cause(t, "full").top_contributors.limit(5))


@query(
    "root_cause_all_top_contributors",
    _contributors_sql(_FULL, _DIMENSIONS, "ORDER BY abs(ch) DESC, dimension, v LIMIT 10"),
)
def _(t: Tables):
    return rounded(_orders_cause(t, "full").top_contributors)


@query(
    "root_cause_reconciliation",
    f"""{_window_sql(*_FULL)}
    SELECT unnest(['status', 'priority', 'code']) AS dimension,
           round(v1 - v0, 2) AS dimension_change, round(v1 - v0, 2) AS overall_change,
           0.0 AS error FROM t""",
)
def _(t: Tables):
    found = rounded(_orders_cause(t, "full").reconciliation)
    return found.withColumn("error", F.abs("error"))


@query("root_cause_comparable", _comparison_sql(*_COMPARABLE))
def _(t: Tables):
    return rounded(_orders_cause(t, "comparable").comparison)


@query("root_cause_comparable_quality", _quality_sql(*_COMPARABLE))
def _(t: Tables):
    return _shown_quality(_orders_cause(t, "comparable"))


@query("root_cause_comparable_contributors", _contributors_sql(_COMPARABLE, _DIMENSIONS))
def _(t: Tables):
    cause = root_cause(gappy_orders(t), "orderdate", "price", _DIMENSIONS)
    return rounded(cause.contributors)


for _period in ("W", "Q", "Y"):

    @query(
        f"root_cause_comparable_{_UNIT[_period]}",
        _contributors_sql((ORDERS, "orderdate", "price", _period, "comparable"), _DIMENSIONS),
    )
    def _(t: Tables, period: str = _period):
        return rounded(_orders_cause(t, "comparable", period).contributors)


_EVENTS = ("events", "ts", "value", "D", "comparable")


@query("root_cause_comparable_day", _contributors_sql(_EVENTS, ["event_type"]))
def _(t: Tables):
    return rounded(root_cause(t.events, "ts", "value", ["event_type"], "D").contributors)


@query("root_cause_comparable_day_quality", _quality_sql(*_EVENTS))
def _(t: Tables):
    return _shown_quality(root_cause(t.events, "ts", "value", ["event_type"], "D"))


@query(
    "root_cause_many_values",
    _contributors_sql(("orders", "o_orderdate", "o_totalprice", "Y", "full"), ["o_custkey"]),
)
def _(t: Tables):
    return rounded(
        analyze_period_change(
            t.orders, "o_orderdate", "o_totalprice", ["o_custkey"], "Y"
        ).contributors
    )


@query(
    "root_cause_by_contribution",
    f"""SELECT * FROM ({_contributors_sql(_FULL, _DIMENSIONS)})
    ORDER BY abs(contribution_pct) DESC, dimension, value LIMIT 8""",
)
def _(t: Tables):
    return rounded(top_by_contribution(_orders_cause(t, "full").contributors))


# What-if ---------------------------------------------------------------


@query(
    "what_if_metric",
    """SELECT 'metric' AS scenario_type, 'o_totalprice' AS metric_column,
        round(s, 2) AS baseline_total, 12.5 AS change_percentage,
        round(s * 1.125, 2) AS projected_total, round(s * 0.125, 2) AS absolute_impact,
        12.5 AS percentage_impact FROM (SELECT sum(o_totalprice) AS s FROM orders)""",
)
def _(t: Tables):
    found = run_operator(
        t.orders, "what_if", {"metric_column": "o_totalprice", "change_percentage": 12.5}
    )
    return rounded(found)


@query(
    "what_if_segment",
    f"""SELECT 'segment' AS scenario_type, 'price' AS metric_column,
        'status' AS dimension_column, 'F' AS segment_value, round(s, 2) AS baseline_total,
        round(g, 2) AS baseline_segment, -20.0 AS change_percentage,
        round(g * 0.8, 2) AS projected_segment, round(s - g * 0.2, 2) AS projected_total,
        round(-0.2 * g, 2) AS absolute_impact, round(-0.2 * g / s * 100, 4) AS percentage_impact
    FROM (SELECT sum(price) AS s, sum(price) FILTER (status = 'F') AS g FROM {ORDERS})""",
)
def _(t: Tables):
    found = whatif.run_what_if(gappy_orders(t), "price", -20, "status", "F")
    return rounded(found, percentage_impact=4)


_SCENARIOS = [("status", "F", 10.0), ("priority", "5-LOW", -20.0), ("status", "O", 5.0)]


@query(
    "what_if_scenarios",
    " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension_column, '{v}' AS segment_value,
            {p} AS change_percentage, round(g, 2) AS baseline_segment, round(s, 2) AS baseline_total,
            round(g * (1 + {p} / 100), 2) AS projected_segment,
            round(s + g * {p} / 100, 2) AS projected_total,
            round(g * {p} / 100, 2) AS absolute_impact,
            round(g * {p} / s, 4) AS percentage_impact
        FROM (SELECT sum(price) AS s, sum(price) FILTER ({d} = '{v}') AS g FROM {ORDERS})"""
        for d, v, p in _SCENARIOS
    ),
)
def _(t: Tables):
    found = whatif.run_scenarios(gappy_orders(t), "price", _SCENARIOS)
    return rounded(found, percentage_impact=4)


# Recommendations -------------------------------------------------------

_FIELDS = ["type", "score", "dimension", "value", "column", "metric", "percentage"]
_PRIORITY = (
    "CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END"
)


def _finding_sql(kind: str, score: str, source: str, **given: str) -> str:
    # Both engines round halves to even here, as the scores do.
    columns = ", ".join(
        f'{given.get(c, "NULL")} AS "{c}"'
        for c in ("dimension", "value", "column", "metric", "percentage")
    )
    clamped = f"CAST(round_even(greatest(0.0, least(100.0, {score})), 0) AS INT)"
    return f"SELECT {kind} AS type, {clamped} AS score, {columns} FROM {source}"


def _quality_findings_sql(source: str, columns: list[str]) -> str:
    gaps = " UNION ALL ".join(
        f"SELECT '{c}' AS c, (count(*) - count({c})) * 100.0 / count(*) AS p FROM {source}"
        for c in columns
    )
    missing = _finding_sql(
        "'data_quality'",
        "CASE WHEN p >= 25 THEN least(100.0, 70 + p - 25) ELSE 45 + (p - 10) * 1.5 END",
        f"({gaps}) WHERE p >= 10",
        column="c",
        percentage="round(p, 2)",
    )
    copies = _finding_sql(
        "'data_quality'",
        "least(95.0, 40 + p * 2)",
        f"""(SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})))
             * 100.0 / count(*) AS p FROM {source}) WHERE p >= 2""",
        percentage="round(p, 2)",
    )
    return f"{missing} UNION ALL {copies}"


def _anomaly_sql(source: str, metric: str) -> str:
    return _finding_sql(
        "'anomaly_investigation'",
        "least(95.0, 55 + z * 8)",
        f"""(SELECT max(abs(x - a) / d) AS z, count(*) AS n, any_value(total) AS total
             FROM (SELECT {metric} AS x FROM {source} WHERE {metric} IS NOT NULL),
                  (SELECT avg({metric}) AS a, stddev_pop({metric}) AS d, count({metric}) AS total
                   FROM {source})
             WHERE abs(x - a) / d >= 3) WHERE n > 0""",
        metric=f"'{metric}'",
        percentage="round(n * 100.0 / total, 2)",
    )


def _totals_sql(source: str, metric: str, dimensions: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS d, CAST({d} AS VARCHAR) AS v, sum({metric}) AS s FROM {source}
            WHERE {metric} IS NOT NULL GROUP BY 2"""
        for d in dimensions
    )


def _segments_sql(source: str, metric: str, dimensions: list[str]) -> str:
    return _finding_sql(
        "CASE WHEN p >= 20 THEN 'growth_opportunity' ELSE 'decline_intervention' END",
        "least(95.0, 50 + abs(p) * 0.35)",
        f"""(SELECT *, (s - a) / abs(a) * 100 AS p FROM (
              SELECT *, avg(s) OVER (PARTITION BY d) AS a, count(*) OVER (PARTITION BY d) AS n
              FROM ({_totals_sql(source, metric, dimensions)})) WHERE n >= 2 AND a <> 0)
            WHERE p >= 20 OR p <= -20""",
        dimension="d",
        value="coalesce(v, 'Missing')",
        metric=f"'{metric}'",
        percentage="round(p, 2)",
    )


def _concentration_sql(source: str, metric: str, dimensions: list[str]) -> str:
    return _finding_sql(
        "'concentration_risk'",
        "least(95.0, 55 + (p - 50) * 1.2)",
        f"""(SELECT *, s / total * 100 AS p FROM (
              SELECT *, sum(s) OVER (PARTITION BY d) AS total, count(*) OVER (PARTITION BY d) AS n,
                     row_number() OVER (PARTITION BY d ORDER BY s DESC, v NULLS LAST) AS r
              FROM ({_totals_sql(source, metric, dimensions)}))
             WHERE n >= 2 AND total > 0 AND r = 1) WHERE p >= 50""",
        dimension="d",
        value="coalesce(v, 'Missing')",
        metric=f"'{metric}'",
        percentage="round(p, 2)",
    )


def _shown(findings: DataFrame, t: Tables, limit: int = 100) -> DataFrame:
    return rounded(recommend.rank_findings(findings, limit).select(*_FIELDS))


_LINE_COLUMNS = ["quantity", "price", "discount", "flag", "status", "shipdate"]


@query(
    "data_quality_findings",
    _quality_findings_sql(LINES, _LINE_COLUMNS)
    + " UNION ALL "
    + _quality_findings_sql(COPIES, ["l_returnflag", "l_linestatus"]),
)
def _(t: Tables):
    gaps = recommend.data_quality_findings(gappy_lines(t))
    copies = recommend.data_quality_findings(few_columns(t))
    return _shown(gaps, t).unionByName(_shown(copies, t))


_TAIL = SQL["skewed_lines"]


@query("anomaly_findings", _anomaly_sql(_TAIL, "tail"))
def _(t: Tables):
    return _shown(recommend.anomaly_findings(skewed_lines(t), "tail"), t)


@query("segment_findings", _segments_sql("customer", "c_acctbal", ["c_mktsegment", "c_nationkey"]))
def _(t: Tables):
    totals = recommend.segment_totals(t.customer, "c_acctbal", ["c_mktsegment", "c_nationkey"])
    return _shown(recommend.segment_findings(totals, "c_acctbal"), t)


@query("concentration_findings", _concentration_sql(LINES, "price", ["flag", "status"]))
def _(t: Tables):
    totals = recommend.segment_totals(gappy_lines(t), "price", ["flag", "status"])
    return _shown(recommend.concentration_findings(totals, "price"), t)


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "status", "price", "orderdate", "priority", "code"]
_ALL_FINDINGS = " UNION ALL ".join(
    [
        _quality_findings_sql(ORDERS, _ORDER_COLUMNS),
        _anomaly_sql(ORDERS, "price"),
        _segments_sql(ORDERS, "price", ["status", "priority", "code"]),
        _concentration_sql(ORDERS, "price", ["status", "priority", "code"]),
    ]
)


def _recommendations(t: Tables) -> recommend.Recommendations:
    return run_operator(
        gappy_orders(t),
        "recommendation",
        {
            "metric_column": "price",
            "dimension_columns": ["status", "priority", "code", "status"],
            "max_recommendations": 100,
        },
    )


@query(
    "recommendations",
    f'SELECT *, {_PRIORITY} AS priority FROM ({_ALL_FINDINGS}) ORDER BY score DESC LIMIT 100',
)
def _(t: Tables):
    return rounded(_recommendations(t).recommendations.select("priority", *_FIELDS))


@query(
    "recommendations_by_priority",
    f"""SELECT p.priority, count(f.score) AS count
    FROM (SELECT unnest(['high', 'medium', 'low']) AS priority) AS p
    LEFT JOIN (SELECT *, {_PRIORITY} AS priority FROM ({_ALL_FINDINGS})) AS f
      ON p.priority = f.priority GROUP BY 1""",
)
def _(t: Tables):
    return _recommendations(t).by_priority()


@query(
    "recommendations_by_type",
    f"SELECT type, count(*) AS count FROM ({_ALL_FINDINGS}) GROUP BY 1",
)
def _(t: Tables):
    return _recommendations(t).by_type()


# Insights --------------------------------------------------------------


@query(
    "insights",
    f"""WITH s AS (SELECT 'tail' AS c, skewness(tail) AS k FROM {_TAIL}),
         o AS (SELECT count(*) FILTER (tail > b + 1.5 * (b - a) OR tail < a - 1.5 * (b - a)) * 100.0
                      / count(tail) AS p
               FROM {_TAIL}, (SELECT quantile_cont(tail, 0.25) AS a,
                                     quantile_cont(tail, 0.75) AS b FROM {_TAIL})),
         r AS (SELECT unnest([{{'a': 'l_quantity', 'b': 'tail', 'r': corr(l_quantity, tail)}},
                              {{'a': 'l_extendedprice', 'b': 'tail',
                                'r': corr(l_extendedprice, tail)}},
                              {{'a': 'l_quantity', 'b': 'l_extendedprice',
                                'r': corr(l_quantity, l_extendedprice)}}]) AS p FROM {_TAIL})
    SELECT 'distribution' AS type, '''tail'' is skewed' AS title FROM s WHERE abs(k) > 1
    UNION ALL
    SELECT 'correlation', '''' || p.a || ''' and ''' || p.b || ''' are strongly correlated'
    FROM r WHERE abs(p.r) > 0.5
    UNION ALL
    SELECT 'outliers', 'Outliers detected in ''tail''' FROM o WHERE p > 1""",
)
def _(t: Tables):
    return insights.generate_insights(skewed_lines(t)).select("type", "title")
