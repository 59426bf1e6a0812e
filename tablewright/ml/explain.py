"""Which features drive a model, overall and for every scored row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.coerce import ref

GLOBAL_FEATURES = 10
LOCAL_FEATURES = 5


def feature_means(df: DataFrame, names: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(ref(n)).alias(n) for n in names]).first()
    return [row[n] or 0.0 for n in names]


def model_weights(model) -> tuple[list[list[float]] | None, str]:
    """Weights per class (one list when they are shared) and the kind of explanation."""
    if isinstance(model, LogisticRegressionModel):
        return model.coefficientMatrix.toArray().tolist(), "exact_linear"
    if isinstance(model, LinearRegressionModel):
        return [model.coefficients.toArray().tolist()], "exact_linear"
    if hasattr(model, "featureImportances"):
        importances = [float(v) for v in model.featureImportances.toArray()]
        return [importances], "approximate_importance_weighted"
    return None, "unavailable"


def overall_weights(weights: Sequence[Sequence[float]], signed: bool) -> list[float]:
    """One weight per feature: as it is when signed, else the mean size over classes."""
    if signed:
        return list(weights[0])
    return [
        sum(abs(w[i]) for w in weights) / len(weights) for i in range(len(weights[0]))
    ]


def importance_table(
    spark, features: Sequence[str], values: Sequence[float], k: int | None = None
) -> DataFrame:
    """feature, importance by absolute size."""
    table = spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    ).orderBy(F.abs("importance").desc(), "feature")
    return table.limit(k) if k else table


def local_contributions(
    scored: DataFrame,
    names: Sequence[str],
    features: Sequence[str],
    weights: Sequence[Sequence[float]],
    means: Sequence[float],
    class_column: str | None = None,
    k: int = LOCAL_FEATURES,
) -> DataFrame:
    """Adds ``contributions``: the k features with the largest weight * (x - mean).

    Plain column arithmetic, so every scored row is explained without a UDF.
    ``class_column`` picks the weights of the predicted class.
    """
    table = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights])
    if class_column is None or len(weights) == 1:
        chosen = F.element_at(table, 1)
    else:
        index = F.least(ref(class_column).cast("int"), F.lit(len(weights) - 1))
        chosen = F.element_at(table, index + 1)
    rows = []
    for i, (name, feature) in enumerate(zip(names, features)):
        effect = chosen[i] * (ref(name) - F.lit(float(means[i])))
        rows.append(
            F.struct(
                F.lit(feature).alias("feature"),
                ref(name).alias("value"),
                effect.alias("contribution"),
                F.when(effect > 0, "increases").otherwise("decreases").alias("direction"),
            )
        )
    larger_first = lambda a, b: F.when(
        F.abs(a["contribution"]) > F.abs(b["contribution"]), -1
    ).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).otherwise(0)
    return scored.withColumn(
        "contributions", F.slice(F.array_sort(F.array(*rows), larger_first), 1, k)
    )
