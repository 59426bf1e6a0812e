"""Scores from one aggregate over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.coerce import ref


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, prediction, rows."""
    return df.groupBy(ref(label).alias("label"), ref(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def confusion_matrix(counts: DataFrame, classes: list) -> DataFrame:
    """Rows are true classes, columns predicted ones, 0 where a pair is absent."""
    return (
        counts.groupBy("label").pivot("prediction", classes).agg(F.sum("rows")).na.fill(0)
    )


def classification_scores(counts: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 of confusion counts."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    none = F.lit(0).cast("long")
    per_class = (
        counts.select(
            F.inline(
                F.array(
                    F.struct(
                        F.col("label").alias("class"),
                        F.col("rows").alias("support"),
                        none.alias("predicted"),
                        hit.alias("hits"),
                    ),
                    F.struct(
                        F.col("prediction").alias("class"),
                        none.alias("support"),
                        F.col("rows").alias("predicted"),
                        none.alias("hits"),
                    ),
                )
            )
        )
        .groupBy("class")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hits").alias("hits"),
        )
    )

    def share(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    scored = per_class.select(
        "support",
        "hits",
        share(F.col("hits"), F.col("predicted")).alias("precision"),
        share(F.col("hits"), F.col("support")).alias("recall"),
        share(F.col("hits") * 2, F.col("support") + F.col("predicted")).alias("f1"),
    )
    total = F.sum("support")
    return scored.agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_score"),
    )


def r2_score(label: str, prediction: str) -> Column:
    """Share of the label's variance that the prediction explains, as an aggregate."""
    error = ref(label) - ref(prediction)
    spread = F.var_pop(ref(label)) * F.count(ref(label))
    return F.lit(1.0) - F.try_divide(F.sum(error * error), spread)


def regression_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """r2_score, mae and rmse."""
    error = ref(label) - ref(prediction)
    return df.agg(
        r2_score(label, prediction).alias("r2_score"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )
