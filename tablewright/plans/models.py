"""Queries on forecasting, metrics, explanation, models and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.forecast.models import linear_trend
from tablewright.forecast.prepare import frequencies, prepare, slot_means
from tablewright.forecast.smoothing import holt_winters
from tablewright.forecast.report import evaluate, last_points, run_forecast
from tablewright.ml import explain, features, metrics
from tablewright.ml.cluster import cluster_sizes, run_clustering, standardise
from tablewright.ml.supervised import explain_model, run_classification, run_regression
from tablewright.plans.inputs import SQL, gappy_lines, gappy_orders
from tablewright.plans.registry import Tables, query, rounded

LINES, ORDERS = SQL["gappy_lines"], SQL["gappy_orders"]

# Forecasting -----------------------------------------------------------

# Daily means per event type on a gap-free calendar, gaps interpolated.
_DAILY = """
    d AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, avg(value) AS v, count(*) AS n
          FROM (SELECT event_type, ts, CASE WHEN day(ts) % 6 <> 0 THEN value END AS value FROM events)
          WHERE value IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT k, min(day) AS a, max(day) AS b, sum(n) AS n, count(*) AS observed
          FROM d GROUP BY 1),
    c AS (SELECT k, a, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM f),
    j AS (SELECT c.k, datediff('day', a, c.day) AS step, CAST(c.day AS TIMESTAMP) AS ts, v
          FROM c LEFT JOIN d ON c.k = d.k AND c.day = d.day),
    g AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER b AS s0,
                 last_value(v IGNORE NULLS) OVER b AS v0,
                 first_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER a AS s1,
                 first_value(v IGNORE NULLS) OVER a AS v1 FROM j
          WINDOW b AS (PARTITION BY k ORDER BY step
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 a AS (PARTITION BY k ORDER BY step
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    series AS (SELECT k, step, ts, v IS NOT NULL AS observed,
                 CASE WHEN v IS NOT NULL THEN v WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0
                      ELSE v0 + (v1 - v0) * (step - s0) / (s1 - s0) END AS value FROM g)"""


def _daily(t: Tables) -> DataFrame:
    """events without values on every sixth day."""
    return t.events.selectExpr(
        "ts", "event_type", "CASE WHEN day(ts) % 6 <> 0 THEN value END AS value"
    )


@query(
    "series_prepared",
    f"""WITH {_DAILY} SELECT k AS event_type, CAST(step AS BIGINT) AS step, ts,
           round(value, 4) AS value, observed FROM series""",
)
def _(t: Tables):
    found = prepare(_daily(t), "ts", "value", ["event_type"]).series
    return rounded(found.select("event_type", "step", "ts", "value", "observed"), 4)


@query(
    "series_frequency",
    f"""WITH {_DAILY}
    SELECT k AS event_type, 'slot' AS unit, CAST(1 AS BIGINT) AS stride, CAST(n AS BIGINT) AS rows,
           observed, CAST(datediff('day', a, b) + 1 AS BIGINT) AS steps FROM f""",
)
def _(t: Tables):
    return prepare(_daily(t), "ts", "value", ["event_type"]).info.select(
        "event_type", "unit", "stride", "rows", "observed", "steps"
    )


@query(
    "series_gaps_minutes",
    """WITH slots AS (SELECT event_type, date_trunc('minute', ts) AS m, count(*) AS n FROM events
               WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
         gaps AS (SELECT *, datediff('minute', lag(m) OVER (PARTITION BY event_type ORDER BY m), m) AS gap FROM slots)
    SELECT event_type, count(*) AS observed, CAST(sum(n) AS BIGINT) AS rows, min(gap) AS min_gap, max(gap) AS max_gap,
           CAST(quantile_cont(gap, 0.5) AS DOUBLE) AS median_gap, min(m) AS first_ts FROM gaps GROUP BY 1""",
)
def _(t: Tables):
    """Gaps between observed minutes, from slices of each series."""
    slots = slot_means(t.events, "ts", "value", ["event_type"], "minute")
    return frequencies(slots, ["event_type"], "minute").select(
        "event_type", "observed", "rows", "min_gap", "max_gap", "median_gap", "first_ts"
    )


@query(
    "series_monthly",
    f"""SELECT status, round(avg(price), 2) AS mean, count(*) AS steps
    FROM (SELECT coalesce(o_orderstatus, '') AS status, date_trunc('month', o_orderdate) AS k,
                 sum(o_totalprice) AS price FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def _(t: Tables):
    monthly = t.orders.groupBy(
        F.col("o_orderstatus").alias("status"), F.trunc("o_orderdate", "month").alias("month")
    ).agg(F.sum("o_totalprice").alias("price"))
    found = prepare(monthly, "month", "price", ["status"]).series
    return rounded(
        found.groupBy("status").agg(
            F.avg("value").alias("mean"), F.count(F.lit(1)).alias("steps")
        )
    )


@query(
    "last_points",
    f"""WITH {_DAILY} SELECT k AS event_type, ts, round(value, 4) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY step DESC) AS r FROM series)
    WHERE r <= 180""",
)
def _(t: Tables):
    found = prepare(_daily(t), "ts", "value", ["event_type"])
    return rounded(last_points(found.series, ["event_type"]).drop("step"), 4)


_LINE = """
    line AS (SELECT k, regr_slope(value, step) AS m, regr_intercept(value, step) AS c,
                    max(step) AS last FROM series GROUP BY k)"""


@query(
    "linear_trend",
    f"""WITH {_DAILY}, {_LINE},
         s AS (SELECT k, m, c, unnest(range(last + 6)) AS step FROM line)
    SELECT k AS event_type, CAST(step AS BIGINT) AS step, round(c + m * step, 4) AS fitted FROM s""",
)
def _(t: Tables):
    found = prepare(_daily(t), "ts", "value", ["event_type"])
    return rounded(linear_trend(found.series, ["event_type"], 5), 4)


@query(
    "forecast_linear",
    f"""WITH {_DAILY}, {_LINE},
         e AS (SELECT k, stddev_samp(value - (c + m * step)) AS sd FROM series JOIN line USING (k)
               GROUP BY 1),
         h AS (SELECT k, m, c, last, sd, unnest(range(1, 8)) AS horizon FROM line JOIN e USING (k)),
         z AS (SELECT k, CAST(horizon AS INT) AS horizon, c + m * (last + horizon) AS value,
                      1.96 * sd * sqrt(horizon) AS w FROM h)
    SELECT k AS event_type, horizon, round(value, 3) AS value, round(value - w, 3) AS lower,
           round(value + w, 3) AS upper FROM z""",
)
def _(t: Tables):
    found = run_forecast(_daily(t), "ts", "value", 7, ["event_type"], "linear_trend")
    return rounded(found.forecast.drop("ts"), 3)


_HELD = """
    n AS (SELECT k, count(*) AS n, greatest(1, least(count(*) // 5, 14)) AS h FROM series GROUP BY 1),
    fit AS (SELECT k, regr_slope(value, step) AS m, regr_intercept(value, step) AS c
            FROM series JOIN n USING (k) WHERE step < n - h GROUP BY 1),
    err AS (SELECT k, h, value, value - (c + m * step) AS e
            FROM series JOIN n USING (k) JOIN fit USING (k) WHERE step >= n - h)"""


@query(
    "forecast_evaluation_linear",
    f"""WITH {_DAILY}, {_HELD}
    SELECT k AS event_type, true AS available, CAST(max(h) AS BIGINT) AS holdout_periods,
           round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse,
           round(CASE WHEN bool_and(value <> 0) THEN avg(abs(e / value)) * 100 END, 3) AS mape
    FROM err GROUP BY 1""",
)
def _(t: Tables):
    found = prepare(_daily(t), "ts", "value", ["event_type"])
    scores = evaluate(found.series, ["event_type"], "linear_trend")
    return rounded(scores, 4, mape=3)


@query(
    "forecast_summary_linear",
    f"""WITH {_DAILY}, {_LINE},
         e AS (SELECT k, arg_max(value, step) AS v FROM series GROUP BY 1),
         x AS (SELECT k, c + m * (last + 7) - v AS ch, v FROM line JOIN e USING (k)),
         u AS (SELECT k, count(*) FILTER (NOT observed) AS filled FROM series GROUP BY 1)
    SELECT k AS event_type, 'linear_trend' AS method, true AS available,
           CASE WHEN ch > 0 THEN 'upward' ELSE 'downward' END AS trend_direction,
           round(ch / abs(v + 1e-9) * 100, 2) AS pct_change_projected,
           CAST(f.n - f.observed AS BIGINT) AS duplicate_rows, filled AS filled_steps
    FROM x JOIN f USING (k) JOIN u USING (k)""",
)
def _(t: Tables):
    found = run_forecast(_daily(t), "ts", "value", 7, ["event_type"], "linear_trend")
    return rounded(found.summary)


_SEASONS = [f"s{j}" for j in range(7)]
_BESIDE = "CASE step % 7 " + " ".join(f"WHEN {j} THEN s{j}" for j in range(7)) + " END"


@query(
    "smoothed_by_fixed_weights",
    f"""WITH RECURSIVE {_DAILY},
         y AS (SELECT k, step, CAST(value AS DOUBLE) AS v FROM series),
         halves AS (SELECT k, avg(v) FILTER (step < 7) AS first, avg(v) FILTER (step BETWEEN 7 AND 13) AS second,
                      max(step) AS last FROM y GROUP BY 1 HAVING count(*) >= 14),
         s AS (SELECT k, (second - first) / 7 AS trend, first - 4 * (second - first) / 7 AS level, last FROM halves),
         r AS (SELECT k, CAST(0 AS BIGINT) AS step, level, trend, last,
                      {", ".join(f"(SELECT v - level - {j + 1} * trend FROM y WHERE y.k = s.k AND step = {j}) AS s{j}"
                                 for j in range(7))} FROM s
               UNION ALL
               SELECT k, step + 1, moved, 0.1 * (moved - level) + 0.9 * trend, last,
                      {", ".join(f"CASE WHEN step % 7 = {j} THEN 0.2 * (v - moved) + 0.8 * s{j} ELSE s{j} END"
                                 for j in range(7))}
               FROM (SELECT r.*, v, 0.3 * (v - {_BESIDE.replace("step", "r.step")}) + 0.7 * (level + trend) AS moved
                     FROM r JOIN y ON y.k = r.k AND y.step = r.step)),
         ahead AS (SELECT k, last + h AS step, level + h * trend AS line, {", ".join(_SEASONS)}
                   FROM (SELECT *, unnest(range(1, 8)) AS h FROM r WHERE step = last + 1)),
         found AS (SELECT k, step, level + trend + {_BESIDE} AS fitted FROM r WHERE step <= last
                   UNION ALL SELECT k, step, line + {_BESIDE} FROM ahead)
    SELECT k AS event_type, CAST(step AS BIGINT) AS step, round(fitted, 4) AS fitted FROM found""",
)
def _(t: Tables):
    series = prepare(_daily(t), "ts", "value", ["event_type"]).series
    found = holt_winters(series.where("steps >= 14"), ["event_type"], 7, (0.3, 0.1, 0.2), slice_steps=14)
    return rounded(found, 4)


@query("forecast_holt_winters")
def _(t: Tables):
    return run_forecast(t.orders, "o_orderdate", "o_totalprice", 30).forecast


@query("forecast_many_series")
def _(t: Tables):
    orders = t.orders.join(
        t.customer.select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    monthly = orders.groupBy("c_nationkey", F.trunc("o_orderdate", "month").alias("month")).agg(
        F.sum("o_totalprice").alias("price")
    )
    return run_forecast(monthly, "month", "price", 6, ["c_nationkey"]).forecast


@query("forecast_evaluation_holt_winters")
def _(t: Tables):
    return run_forecast(_daily(t), "ts", "value", 7, ["event_type"]).evaluation


# Metrics and explanation on formula predictions ------------------------

_PREDICTED = """(SELECT o_orderpriority AS label,
    CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0 THEN '6-NEVER'
         ELSE o_orderpriority END AS prediction FROM orders)"""


_CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]
_EACH_CLASS = ", ".join(
    f"""count(*) FILTER (prediction = '{c}') AS "{c}\"""" for c in _CLASSES
)


def _predicted(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderpriority AS label",
        "CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0 THEN '6-NEVER' "
        "ELSE o_orderpriority END AS prediction",
    )


@query(
    "confusion_matrix",
    f"SELECT label, {_EACH_CLASS} FROM {_PREDICTED} GROUP BY 1",
)
def _(t: Tables):
    counts = metrics.confusion_counts(_predicted(t), "label", "prediction")
    return metrics.confusion_matrix(counts, _CLASSES)


@query(
    "classification_scores",
    f"""WITH p AS (SELECT * FROM {_PREDICTED}),
         c AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
         s AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support,
                      (SELECT count(*) FROM p WHERE prediction = c) AS predicted,
                      (SELECT count(*) FROM p WHERE prediction = c AND label = c) AS hits FROM c),
         r AS (SELECT *, coalesce(hits * 1.0 / nullif(predicted, 0), 0.0) AS pr,
                      coalesce(hits * 1.0 / nullif(support, 0), 0.0) AS re,
                      2.0 * hits / (support + predicted) AS f FROM s)
    SELECT round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy,
           round(CAST(sum(pr * support) AS DOUBLE) / sum(support), 6) AS precision,
           round(CAST(sum(re * support) AS DOUBLE) / sum(support), 6) AS recall,
           round(CAST(sum(f * support) AS DOUBLE) / sum(support), 6) AS f1_score FROM r""",
)
def _(t: Tables):
    counts = metrics.confusion_counts(_predicted(t), "label", "prediction")
    return rounded(metrics.classification_scores(counts), 6)


@query(
    "regression_scores",
    """SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2_score,
           round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse
    FROM (SELECT p_retailprice AS y, p_retailprice - (900 + p_size) AS e FROM part)""",
)
def _(t: Tables):
    scored = t.part.withColumn("prediction", F.lit(900.0) + F.col("p_size"))
    return rounded(metrics.regression_scores(scored, "p_retailprice", "prediction"), 4, r2_score=6)


@query(
    "local_contributions",
    """WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem),
         x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                      unnest([{'f': 'l_quantity', 'e': 0.5 * (l_quantity - a)},
                              {'f': 'l_discount', 'e': -100.0 * (l_discount - b)},
                              {'f': 'l_tax', 'e': 20.0 * (l_tax - c)}]) AS p FROM lineitem, m)
    SELECT p.f AS feature, CASE WHEN p.e > 0 THEN 'increases' ELSE 'decreases' END AS direction,
           count(*) AS rows, round(sum(p.e), 2) AS contribution
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey
                                       ORDER BY abs(p.e) DESC) AS r FROM x)
    WHERE r <= 2 GROUP BY 1, 2""",
)
def _(t: Tables):
    names = ["l_quantity", "l_discount", "l_tax"]
    means = explain.feature_means(t.lineitem, names)
    explained = explain.local_contributions(
        t.lineitem, names, names, [[0.5, -100.0, 20.0]], means, k=2
    )
    rows = explained.select(F.inline("contributions"))
    return rounded(
        rows.groupBy("feature", "direction").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("contribution").alias("contribution")
        )
    )


# Features and splits ---------------------------------------------------


@query(
    "class_counts",
    f"SELECT coalesce(status, 'Unknown') AS label, count(*) AS rows FROM {ORDERS} GROUP BY 1",
)
def _(t: Tables):
    return features.class_counts(gappy_orders(t), "status")


@query(
    "screened_features",
    """SELECT unnest(['o_orderkey', 'price', 'status', 'code']) AS feature
    UNION ALL SELECT 'priority'""",
)
def _(t: Tables):
    orders = gappy_orders(t).withColumns(
        {"same": F.lit(1), "name": F.concat(F.lit("order "), "o_orderkey")}
    )
    asked = ["o_orderkey", "price", "status", "priority", "code"]
    asked += ["orderdate", "same", "name", "absent", "o_custkey"]
    kept, _ = features.screen_features(orders, "o_custkey", asked, orders.count())
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


@query(
    "encoded_features",
    f"""SELECT l_orderkey, l_linenumber,
           CAST(dense_rank() OVER (ORDER BY coalesce(flag, 'Unknown')) - 1 AS DOUBLE) AS f0,
           coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {LINES})) AS f1 FROM {LINES}""",
)
def _(t: Tables):
    encoded, _ = features.encode_features(gappy_lines(t), ["flag", "price"])
    return encoded.select("l_orderkey", "l_linenumber", "f0", "f1")


@query(
    "stratified_split",
    """SELECT o_orderpriority AS label,
           CAST(greatest(1, floor(count(*) * 0.8)) AS BIGINT) AS train,
           CAST(count(*) - greatest(1, floor(count(*) * 0.8)) AS BIGINT) AS test,
           CAST(ceil(count(*) / 5.0) AS BIGINT) AS first_fold,
           CAST(floor(count(*) / 5.0) AS BIGINT) AS last_fold
    FROM orders GROUP BY 1""",
)
def _(t: Tables):
    split = features.with_split(t.orders, 5, "o_orderpriority")
    return split.groupBy(F.col("o_orderpriority").alias("label")).agg(
        F.count_if(~F.col("is_test")).alias("train"),
        F.count_if("is_test").alias("test"),
        F.count_if(F.col("fold") == 0).alias("first_fold"),
        F.count_if(F.col("fold") == 4).alias("last_fold"),
    )


@query(
    "standardised",
    """SELECT p_partkey, round((p_size - a) / b, 6) AS p_size,
           round((p_retailprice - c) / d, 6) AS p_retailprice
    FROM part, (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c,
                       stddev_pop(p_retailprice) AS d FROM part)""",
)
def _(t: Tables):
    table = t.part.select(
        "p_partkey", F.col("p_size").cast("double"), F.col("p_retailprice")
    )
    return rounded(standardise(table, ["p_size", "p_retailprice"]), 6)


# Models ----------------------------------------------------------------


@query("classification_logistic")
def _(t: Tables):
    return run_classification(
        t.orders, "o_orderstatus", ["o_totalprice", "o_orderpriority"], "logistic_regression"
    ).scores


@query("classification_tree")
def _(t: Tables):
    return run_classification(
        t.orders, "o_orderstatus", ["o_totalprice", "o_orderpriority", "o_custkey"], "decision_tree"
    ).importances


@query("regression_linear")
def _(t: Tables):
    return run_regression(
        t.part, "p_retailprice", ["p_size", "p_brand", "p_partkey"], "linear_regression"
    ).scores


@query("regression_actual_vs_predicted")
def _(t: Tables):
    return run_regression(
        t.part, "p_retailprice", ["p_size", "p_brand"], "linear_regression"
    ).actual_vs_predicted


@query("kmeans_sizes")
def _(t: Tables):
    return run_clustering(t.part, ["p_size", "p_retailprice", "p_partkey"]).sizes


@query("kmeans_projection")
def _(t: Tables):
    found = run_clustering(t.customer, ["c_acctbal", "c_nationkey", "c_custkey"])
    return found.points


@query("dbscan_sizes")
def _(t: Tables):
    return run_clustering(t.customer, ["c_acctbal", "c_nationkey"], "dbscan", eps=0.05).sizes


# Five features, so cells are met by zones. The SQL compares all pairs of customers.
_FIVE = ["c_acctbal", "c_nationkey", "c_custkey", "seventh", "eleventh"]
_CUSTOMERS = """(SELECT c_custkey AS id, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
    CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(c_custkey % 7 AS DOUBLE) AS seventh,
    CAST(c_custkey % 11 AS DOUBLE) AS eleventh FROM customer)"""


@query(
    "dbscan_five_features",
    f"""WITH m AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(_FIVE))}
               FROM {_CUSTOMERS}),
         p AS (SELECT id, {", ".join(f"({c} - m{i}) / d{i} AS x{i}" for i, c in enumerate(_FIVE))}
               FROM {_CUSTOMERS}, m),
         n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b
               ON {" + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(5))} <= 0.8 * 0.8),
         core AS (SELECT a FROM n GROUP BY 1 HAVING count(*) >= 5),
         reached AS (SELECT DISTINCT b FROM n WHERE a IN (SELECT a FROM core))
    SELECT (SELECT count(*) FROM reached) AS clustered,
           (SELECT count(*) FROM p) - (SELECT count(*) FROM reached) AS noise""",
)
def _(t: Tables):
    table = t.customer.selectExpr(
        "c_acctbal", "c_nationkey", "c_custkey", "c_custkey % 7 AS seventh", "c_custkey % 11 AS eleventh"
    )
    found = run_clustering(table, _FIVE, "dbscan", eps=0.8).assigned
    return found.agg(
        F.count_if(F.col("cluster") >= 0).alias("clustered"), F.count_if(F.col("cluster") < 0).alias("noise")
    )


@query(
    "kmeans_fixed_point",
    "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS moved_centres FROM part",
)
def _(t: Tables):
    """Every row is at its nearest centre, and every centre is the mean of its rows."""
    names = ["p_size", "p_retailprice", "p_partkey"]
    found = run_clustering(t.part, names)
    table = standardise(found.assigned.select(*[F.col(c).cast("double") for c in names], "cluster"), names)
    centres = table.groupBy("cluster").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).collect()

    def distance(row):
        total = F.lit(0.0)
        for i, c in enumerate(names):
            total = total + (F.col(c) - F.lit(row[f"m{i}"])) ** 2
        return total

    # The centres that the fit returned, against the means of the rows it gave them.
    resting = sum(
        all(abs(r[f"m{i}"] - found.centres[r["cluster"]][i]) <= 1e-2 for i in range(len(names))) for r in centres
    )
    own = F.coalesce(*[F.when(F.col("cluster") == r["cluster"], distance(r)) for r in centres])
    nearest = F.least(*[distance(r) for r in centres])
    # The fit stops when centres move by less than its tolerance, so rows may lie that close to a border.
    return table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.sqrt(own) - F.sqrt(nearest) > 1e-2).alias("misplaced"),
        F.lit(4 - resting).cast("long").alias("moved_centres"),
    )


# A label that one discrete feature decides, so that every tree must find it. The scores and the
# confusion of the held-out fifth then follow from the class sizes alone.
_DECIDED = """(SELECT *, CASE WHEN l_linenumber <= 2 THEN 'few' ELSE 'many' END AS lines FROM lineitem)"""
_TEST_ROWS = f"""SELECT lines, count(*) - greatest(1, floor(count(*) * 0.8)) AS n FROM {_DECIDED} GROUP BY 1"""


def _decided(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_linenumber", "l_tax", "CASE WHEN l_linenumber <= 2 THEN 'few' ELSE 'many' END AS lines"
    )


for _algorithm, _validated in (("decision_tree", True), ("boosted_trees", False)):

    @query(
        f"classification_exact_{_algorithm}",
        f"""SELECT lines AS label, CAST(CASE lines WHEN 'few' THEN n ELSE 0 END AS BIGINT) AS few,
               CAST(CASE lines WHEN 'many' THEN n ELSE 0 END AS BIGINT) AS many, 1.0 AS accuracy
        FROM ({_TEST_ROWS})""",
    )
    def _(t: Tables, algorithm: str = _algorithm, validated: bool = _validated):
        found = run_classification(
            _decided(t), "lines", ["l_linenumber", "l_tax"], algorithm, cross_validate=validated
        )
        names = F.array(*[F.lit(c) for c in found.classes])
        return found.confusion.select(
            names[F.col("label").cast("int")].alias("label"),
            F.col("`0.0`").alias(found.classes[0]),
            F.col("`1.0`").alias(found.classes[1]),
            F.lit(round(found.best_score, 6)).alias("accuracy"),
        )


@query(
    "explain_model_exact",
    "SELECT 'l_linenumber' AS feature, 1.0 AS importance UNION ALL SELECT 'l_tax', 0.0",
)
def _(t: Tables):
    found, _ = explain_model(_decided(t), "lines", ["l_linenumber", "l_tax"], algorithm="decision_tree")
    return rounded(found, 6)


@query(
    "regression_exact_linear",
    """SELECT 'linear_regression' AS model, 1.0 AS r2_score, 0.0 AS mae, 0.0 AS rmse, 1.0 AS cv_r2_mean,
           0.0 AS cv_r2_std, CAST(5 AS INT) AS cv_folds""",
)
def _(t: Tables):
    table = t.part.selectExpr("p_size", "p_partkey", "3 * p_size - 0.25 * p_partkey + 7 AS y")
    scores = run_regression(table, "y", ["p_size", "p_partkey"], "linear_regression").scores
    return rounded(scores, 3).select(
        *[(F.abs(c) if c not in ("model", "cv_folds") else F.col(c)).alias(c) for c in scores.columns]
    )


@query(
    "cluster_sizes",
    "SELECT CAST(label AS INT) AS cluster, count(*) AS rows FROM embeddings GROUP BY 1",
)
def _(t: Tables):
    return cluster_sizes(t.embeddings, "label")
