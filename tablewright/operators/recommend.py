"""Rule-based recommendations with deterministic scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.functions.coerce import (
    label,
    number,
    require_rows,
    text,
)
from tablewright.operators.profile import duplicate_count, missing_by_column

# Thresholds and limits of the rules.
MAX_RECOMMENDATIONS = 20
HIGH_PRIORITY = 75
MEDIUM_PRIORITY = 45
MISSING_WARNING = 10.0
MISSING_CRITICAL = 25.0
DUPLICATE_WARNING = 2.0
CONCENTRATION = 50.0
STRONG_SEGMENT = 20.0
WEAK_SEGMENT = -20.0
ANOMALY_Z = 3.0
ANOMALY_ROWS = 5

_EVIDENCE = (
    "dimension string, value string, column string, metric string, segment_value double, "
    "reference_value double, percentage double, affected_rows long, total_rows long, "
    "max_abs_z double, sample_values array<double>"
)
_SCHEMA = (
    "rule int, position int, type string, raw_score double, title string, " + _EVIDENCE
)


def _finding(source: DataFrame, rule: int, **columns: Column) -> DataFrame:
    """Rows of ``source`` as findings; evidence that is not given stays NULL."""
    fields = [part.strip().rsplit(" ", 1) for part in _SCHEMA.split(",")]
    columns = {"rule": F.lit(rule), **columns}
    return source.select(
        *[
            columns.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in fields
        ]
    )


def data_quality_findings(df: DataFrame) -> DataFrame:
    """Columns with >= 10 % missing values and tables with >= 2 % duplicates."""
    pct = F.try_divide(F.col("missing_count") * 100.0, F.col("total_rows"))
    gaps = missing_by_column(df).withColumn("pct", pct)
    gaps = gaps.where(F.col("pct") >= MISSING_WARNING)
    missing = _finding(
        gaps,
        1,
        position=F.col("position"),
        type=F.lit("data_quality"),
        raw_score=F.when(
            F.col("pct") >= MISSING_CRITICAL,
            F.least(F.lit(100.0), 70 + (F.col("pct") - MISSING_CRITICAL)),
        ).otherwise(45 + (F.col("pct") - MISSING_WARNING) * 1.5),
        title=F.concat(F.lit("Review missing values in "), "column"),
        column=F.col("column"),
        percentage=F.round("pct", 2),
        affected_rows=F.col("missing_count"),
        total_rows=F.col("total_rows"),
    )
    copies = duplicate_count(df).withColumn(
        "pct", F.try_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows"))
    )
    duplicates = _finding(
        copies.where(F.col("pct") >= DUPLICATE_WARNING),
        2,
        position=F.lit(0),
        type=F.lit("data_quality"),
        raw_score=F.least(F.lit(95.0), 40 + F.col("pct") * 2),
        title=F.lit("Review duplicate records"),
        percentage=F.round("pct", 2),
        affected_rows=F.col("duplicate_rows"),
        total_rows=F.col("total_rows"),
    )
    return missing.unionByName(duplicates)


def anomaly_findings(df: DataFrame, metric_column: str) -> DataFrame:
    """Values at least 3 population standard deviations from the mean."""
    values = df.select(number(df, metric_column).alias("x")).na.drop()
    facts = values.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")
    ).first()
    usable = facts["n"] >= ANOMALY_ROWS and facts["sd"] > 0
    mean, sd = (facts["mean"], facts["sd"]) if usable else (0.0, 1.0)
    z = F.abs((F.col("x") - F.lit(mean)) / F.lit(sd))
    flagged = values.select("x", z.alias("z")).where(
        (F.col("z") >= ANOMALY_Z) & F.lit(usable)
    )
    largest = flagged.orderBy(F.col("z").desc(), "x").limit(5).select(F.round("x", 2))
    samples = [F.lit(r[0]) for r in largest.collect()]
    found = flagged.agg(F.count("x").alias("count"), F.max("z").alias("max_z"))
    return _finding(
        found.where("count > 0"),
        3,
        position=F.lit(0),
        type=F.lit("anomaly_investigation"),
        raw_score=F.least(F.lit(95.0), 55 + F.col("max_z") * 8),
        title=F.lit(f"Investigate unusual {metric_column} values"),
        metric=F.lit(metric_column),
        percentage=F.round(F.col("count") * 100.0 / F.lit(max(facts["n"], 1)), 2),
        affected_rows=F.col("count"),
        total_rows=F.lit(facts["n"]),
        max_abs_z=F.round("max_z", 2),
        sample_values=F.array(*samples).cast("array<double>"),
    )


def segment_totals(
    df: DataFrame, metric_column: str, dimensions: Sequence[str]
) -> DataFrame:
    """position, dimension, value, total for all dimensions in one shuffle."""
    return (
        df.select(
            number(df, metric_column).alias("metric"),
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("position"),
                            F.lit(d).alias("dimension"),
                            text(df, d).alias("value"),
                        )
                        for i, d in enumerate(dimensions)
                    ]
                )
            ),
        )
        .na.drop(subset=["metric"])
        .groupBy("position", "dimension", "value")
        .agg(F.sum("metric").alias("total"))
    )


def _with_dimension_facts(totals: DataFrame) -> DataFrame:
    """Adds segment count, mean and sum of the dimension.

    The facts table has one row per dimension named by the caller, so it is
    broadcast; a window would gather a whole dimension in one task.
    """
    facts = totals.groupBy("position").agg(
        F.count(F.lit(1)).alias("segments"),
        F.avg("total").alias("mean_total"),
        F.sum("total").alias("sum_total"),
    )
    return totals.join(F.broadcast(facts), "position").where("segments >= 2")


def segment_findings(totals: DataFrame, metric_column: str) -> DataFrame:
    """Segments at least 20 % above or below the mean segment total."""
    against = _with_dimension_facts(totals).where("mean_total != 0")
    pct = (F.col("total") - F.col("mean_total")) / F.abs("mean_total") * 100
    judged = against.withColumn("pct", pct).where(
        (F.col("pct") >= STRONG_SEGMENT) | (F.col("pct") <= WEAK_SEGMENT)
    )
    strong = F.col("pct") >= STRONG_SEGMENT
    return _finding(
        judged,
        4,
        position=F.col("position"),
        type=F.when(strong, "growth_opportunity").otherwise("decline_intervention"),
        raw_score=F.least(F.lit(95.0), 50 + F.abs("pct") * 0.35),
        title=F.concat(
            F.when(strong, f"Strong {metric_column} performance in ").otherwise(
                f"Investigate weak {metric_column} performance in "
            ),
            label(F.col("value")),
        ),
        dimension=F.col("dimension"),
        value=F.col("value"),
        metric=F.lit(metric_column),
        segment_value=F.round("total", 2),
        reference_value=F.round("mean_total", 2),
        percentage=F.round("pct", 2),
    )


def concentration_findings(totals: DataFrame, metric_column: str) -> DataFrame:
    """Dimensions whose largest segment holds at least half of the total."""
    # Smallest value first on ties, NULL last.
    size = F.struct(-F.col("total"), F.col("value").isNull(), F.col("value"))
    largest = totals.groupBy("position", "dimension").agg(
        F.min(size)["value"].alias("value"),
        F.max("total").alias("largest"),
        F.sum("total").alias("sum_total"),
        F.count(F.lit(1)).alias("segments"),
    )
    share = F.try_divide(F.col("largest"), F.col("sum_total")) * 100
    risky = (
        largest.where("segments >= 2 AND sum_total > 0")
        .withColumn("share", share)
        .where(F.col("share") >= CONCENTRATION)
    )
    return _finding(
        risky,
        5,
        position=F.col("position"),
        type=F.lit("concentration_risk"),
        raw_score=F.least(F.lit(95.0), 55 + (F.col("share") - CONCENTRATION) * 1.2),
        title=F.concat(
            F.lit(f"High {metric_column} concentration in "), label(F.col("value"))
        ),
        dimension=F.col("dimension"),
        value=F.col("value"),
        metric=F.lit(metric_column),
        segment_value=F.round("largest", 2),
        reference_value=F.round("sum_total", 2),
        percentage=F.round("share", 2),
    )


def rank_findings(findings: DataFrame, max_recommendations: int) -> DataFrame:
    """Deduplicate, clamp to 0..100, set the priority, keep the best."""
    sequence = [
        "rule",
        "position",
        F.col("value").isNull(),
        F.col("value"),
    ]
    shown = F.when(F.col("dimension").isNotNull(), label(F.col("value")))
    first = Window.partitionBy("type", "dimension", "shown", "column", "metric").orderBy(
        *sequence
    )
    unique = (
        findings.withColumn("shown", shown)
        .withColumn("copy", F.row_number().over(first))
        .where("copy = 1")
    )
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "raw_score")), 0).cast("int")
    scored = unique.withColumn("score", score)
    best = scored.orderBy(F.col("score").desc(), *sequence).limit(max_recommendations)
    return best.select(
        "rule",
        "position",
        "type",
        F.when(F.col("score") >= HIGH_PRIORITY, "high")
        .when(F.col("score") >= MEDIUM_PRIORITY, "medium")
        .otherwise("low")
        .alias("priority"),
        "score",
        "title",
        "dimension",
        F.col("shown").alias("value"),
        "column",
        "metric",
        "segment_value",
        "reference_value",
        "percentage",
        "affected_rows",
        "total_rows",
        "max_abs_z",
        "sample_values",
    )


@dataclass(frozen=True)
class Recommendations:
    recommendations: DataFrame
    valid_metric_rows: int
    dimension_columns: list[str]

    def by_priority(self) -> DataFrame:
        """Counts per priority, zero included."""
        counts = self.recommendations.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
        levels = self.recommendations.sparkSession.createDataFrame(
            [("high",), ("medium",), ("low",)], "priority string"
        )
        return levels.join(counts, "priority", "left").select(
            "priority", F.coalesce("n", F.lit(0)).alias("count")
        )

    def by_type(self) -> DataFrame:
        return self.recommendations.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def generate_recommendations(
    df: DataFrame,
    metric_column: str | None = None,
    dimension_columns: Sequence[str] | None = None,
    max_recommendations: int = MAX_RECOMMENDATIONS,
) -> Recommendations:
    """Data-quality, anomaly, segment and concentration rules, best score first."""
    dimensions = list(dict.fromkeys(dimension_columns or []))
    require_rows(df, "Dataset is empty")
    if metric_column is not None and metric_column not in df.columns:
        raise ValueError(f"Metric column '{metric_column}' does not exist")
    for d in dimensions:
        if d not in df.columns:
            raise ValueError(f"Dimension column '{d}' does not exist")
    findings = data_quality_findings(df)
    valid = 0
    if metric_column is not None:
        valid = df.agg(F.count(number(df, metric_column))).first()[0]
    if valid:
        findings = findings.unionByName(anomaly_findings(df, metric_column))
        if dimensions:
            totals = segment_totals(df, metric_column, dimensions)
            findings = findings.unionByName(
                segment_findings(totals, metric_column)
            ).unionByName(concentration_findings(totals, metric_column))
    try:
        wanted = int(max_recommendations)
    except (TypeError, ValueError):
        wanted = MAX_RECOMMENDATIONS
    # At most 100 rows, kept so that the counts do not run every rule again.
    best = written(rank_findings(findings, max(1, min(100, wanted))))
    in_order = best.orderBy(F.col("score").desc(), "rule", "position", "value")
    return Recommendations(in_order.drop("rule", "position"), valid, dimensions)
