"""Classification and regression: try models, keep the best, explain it."""

from __future__ import annotations

import statistics
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.functions.coerce import number, text
from tablewright.ml.explain import (
    GLOBAL_FEATURES,
    feature_means,
    importance_table,
    local_contributions,
    model_weights,
    overall_weights,
)
from tablewright.ml.features import (
    MIN_ROWS,
    SEED,
    UNKNOWN,
    assemble,
    binned,
    check_training_input,
    class_counts,
    encode_features,
    screen_features,
    with_split,
)
from tablewright.ml.metrics import (
    classification_scores,
    confusion_counts,
    confusion_matrix,
    r2_score,
    regression_scores,
)

FOLDS = 5
TREES = 200
FOREST_DEPTH = 10
SHOWN_PREDICTIONS = 200
# With more classes the confusion counts stay long (label, prediction, rows); the figures are the same.
SHOWN_CLASSES = 1000


@dataclass(frozen=True)
class Trained:
    """``scores``: one row per model. ``scored``: test rows with contributions."""

    task: str
    model: object
    best_model: str
    best_score: float
    features: list[str]
    warnings: list[str]
    scores: DataFrame
    importances: DataFrame
    scored: DataFrame
    explanation: str
    classes: list[str]
    confusion: DataFrame | None = None
    actual_vs_predicted: DataFrame | None = None


def classifiers(rows: int, classes: int) -> dict[str, Callable]:
    """Estimator factories; boosted trees run only when asked for."""

    def boosted():
        columns = {"labelCol": "label", "featuresCol": "binned", "weightCol": "weight"}
        trees = GBTClassifier(maxIter=100, seed=SEED, **columns)
        return trees if classes == 2 else OneVsRest(classifier=trees, **columns)

    return {
        "logistic_regression": lambda: LogisticRegression(
            maxIter=1000, regParam=1.0 / rows, standardization=False, labelCol="label"
        ),
        "decision_tree": lambda: DecisionTreeClassifier(
            maxDepth=8, seed=SEED, labelCol="label"
        ),
        "random_forest": lambda: RandomForestClassifier(
            numTrees=TREES, maxDepth=FOREST_DEPTH, seed=SEED, labelCol="label"
        ),
        "boosted_trees": boosted,
    }


def regressors() -> dict[str, Callable]:
    return {
        "linear_regression": lambda: LinearRegression(labelCol="label"),
        "random_forest": lambda: RandomForestRegressor(
            numTrees=TREES, maxDepth=FOREST_DEPTH, seed=SEED, labelCol="label"
        ),
        "gradient_boosting": lambda: GBTRegressor(
            maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED, labelCol="label"
        ),
    }


def _chosen(available: dict[str, Callable], algorithm: str | None, optional: set[str]):
    if algorithm in available:
        return {algorithm: available[algorithm]}
    return {name: make for name, make in available.items() if name not in optional}


def weighted_points(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """label, ``binned`` and ``weight``: the rows of one class in the same bins are one point.

    A tree learner sees nothing of a row but its bins, so trees of the weighted
    points are those of the rows, and each of the many rounds reads points only.
    """
    label = rows.schema["label"]
    bins = [f"bin_{n}" for n in names]
    points = rows.groupBy("label", *bins).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    vectors = VectorAssembler(inputCols=bins, outputCol="binned").transform(points)
    return written(
        vectors.select(F.col("label").alias("label", metadata=label.metadata), "binned", "weight")
    )


def _fitted(make: Callable, rows: DataFrame, names: Sequence[str]):
    estimator = make()
    if estimator.getFeaturesCol() == "binned":
        rows = weighted_points(rows, names)
    return estimator.fit(rows)


def _cross_validated(
    table: DataFrame, names: Sequence[str], make: Callable, folds: int, score: Callable[[], Column]
) -> list[float]:
    """Score of each fold by a model fitted on the others; folds train side by side."""

    def one(fold: int) -> float:
        model = _fitted(make, table.where(F.col("fold") != fold), names)
        scored = model.transform(table.where(F.col("fold") == fold))
        return scored.agg(score()).first()[0]

    with ThreadPoolExecutor(max_workers=folds) as pool:
        return list(pool.map(one, range(folds)))


def _fit_all(
    table: DataFrame,
    names: Sequence[str],
    makers: dict[str, Callable],
    folds: int,
    score_table: Callable[[DataFrame], DataFrame],
    fold_score: Callable[[], Column],
    cv_name: str,
) -> tuple[dict, dict]:
    """Test scores per model, with the mean and spread over the folds."""
    train, test = table.where(~F.col("is_test")), table.where("is_test")
    models, scores = {}, {}
    for name, make in makers.items():
        models[name] = _fitted(make, train, names)
        scores[name] = score_table(models[name].transform(test)).first().asDict()
        scores[name].update({f"{cv_name}_mean": None, f"{cv_name}_std": None, "cv_folds": None})
        if folds >= 2:
            values = _cross_validated(table, names, make, folds, fold_score)
            scores[name].update(
                {
                    f"{cv_name}_mean": statistics.fmean(values),
                    f"{cv_name}_std": statistics.pstdev(values),
                    "cv_folds": folds,
                }
            )
    return models, scores


def _score_df(spark, scores: dict) -> DataFrame:
    names = list(next(iter(scores.values())))
    schema = "model string, " + ", ".join(
        f"{n} {'int' if n == 'cv_folds' else 'double'}" for n in names
    )
    return spark.createDataFrame(
        [(model, *[row[n] for n in names]) for model, row in scores.items()], schema
    )


def _best(scores: dict, main: str) -> str:
    """First model with the highest score."""
    return max(scores, key=lambda name: scores[name][main])


def run_classification(
    df: DataFrame,
    target: str,
    feature_columns: Sequence[str],
    algorithm: str | None = None,
    cross_validate: bool = True,
) -> Trained:
    """Predict a categorical column."""
    rows = check_training_input(df, target, feature_columns)
    features, warnings = screen_features(df, target, feature_columns, rows)
    counts = class_counts(df, target)
    facts = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("rows").alias("smallest")).first()
    if facts["classes"] < 2:
        raise ValueError(f"'{target}' needs two distinct classes, found {facts['classes']}")
    stratified = facts["smallest"] >= 2
    if not stratified:
        warnings.append(
            "A class with a single row kept the split from being stratified, so scores vary more."
        )
    folds = min(FOLDS, facts["smallest"]) if stratified and cross_validate else 0

    encoded, names = encode_features(df, features)
    labelled = encoded.withColumn("_class", F.coalesce(text(df, target), F.lit(UNKNOWN)))
    indexer = StringIndexer(
        inputCol="_class", outputCol="label", stringOrderType="alphabetAsc"
    ).fit(labelled)
    classes = list(indexer.labels)
    ready = indexer.transform(labelled).select("label", *names)
    table = assemble(with_split(ready, folds, "label" if stratified else None), names)
    # The label's metadata tells tree learners how many classes there are.
    table = table.withColumn(
        "label", F.col("label").alias("label", metadata=ready.schema["label"].metadata)
    )

    makers = _chosen(classifiers(rows, len(classes)), algorithm, {"boosted_trees"})
    if "boosted_trees" in makers:
        table = binned(table, names)
    models, scores = _fit_all(
        table,
        names,
        makers,
        folds,
        lambda scored: classification_scores(confusion_counts(scored, "label", "prediction")),
        lambda: F.avg((F.col("label") == F.col("prediction")).cast("double")),
        "cv_accuracy",
    )
    best = _best(scores, "accuracy")
    model = models[best]
    scored = model.transform(table.where("is_test"))
    confusion = confusion_counts(scored, "label", "prediction")
    if len(classes) <= SHOWN_CLASSES:
        confusion = confusion_matrix(confusion, [float(i) for i in range(len(classes))])
    importance, explained, kind = _explained(
        df.sparkSession, model, table, scored, names, features, False, "prediction"
    )
    return Trained(
        task="classification",
        model=model,
        best_model=best,
        best_score=scores[best]["accuracy"],
        features=features,
        warnings=warnings,
        scores=_score_df(df.sparkSession, scores),
        importances=importance,
        scored=explained,
        explanation=kind,
        classes=classes,
        confusion=confusion,
    )


def _explained(spark, model, table, scored, names, features, signed, class_column):
    weights, kind = model_weights(model)
    if weights is None:
        return importance_table(spark, [], []), scored, kind
    means = feature_means(table, names)
    local = local_contributions(scored, names, features, weights, means, class_column)
    top = importance_table(spark, features, overall_weights(weights, signed), GLOBAL_FEATURES)
    return top, local, kind


def run_regression(
    df: DataFrame,
    target: str,
    feature_columns: Sequence[str],
    algorithm: str | None = None,
    cross_validate: bool = True,
) -> Trained:
    """Predict a numeric column; rows without a target are left out."""
    rows = check_training_input(df, target, feature_columns)
    features, warnings = screen_features(df, target, feature_columns, rows)
    known = df.withColumn("label", number(df, target)).na.drop(subset=["label"])
    facts = known.agg(
        F.count("label").alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).first()
    if facts["rows"] < MIN_ROWS:
        raise ValueError(
            f"regression needs at least {MIN_ROWS} rows with a target, found {facts['rows']}"
        )
    if facts["lo"] == facts["hi"]:
        raise ValueError(f"target column '{target}' is constant")
    folds = min(FOLDS, facts["rows"] // 5) if facts["rows"] >= 25 and cross_validate else 0
    encoded, names = encode_features(known, features)
    table = assemble(with_split(encoded.select("label", *names), folds), names)
    makers = _chosen(regressors(), algorithm, set())
    models, scores = _fit_all(
        table,
        names,
        makers,
        folds,
        lambda scored: regression_scores(scored, "label", "prediction"),
        lambda: r2_score("label", "prediction"),
        "cv_r2",
    )
    best = _best(scores, "r2_score")
    model = models[best]
    scored = model.transform(table.where("is_test"))
    importance, explained, kind = _explained(
        df.sparkSession, model, table, scored, names, features, True, None
    )
    shown = (
        scored.orderBy("draw_rank")
        .limit(SHOWN_PREDICTIONS)
        .select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    )
    return Trained(
        task="regression",
        model=model,
        best_model=best,
        best_score=scores[best]["r2_score"],
        features=features,
        warnings=warnings,
        scores=_score_df(df.sparkSession, scores),
        importances=importance,
        scored=explained,
        explanation=kind,
        classes=[],
        actual_vs_predicted=shown,
    )


def explain_model(
    df: DataFrame,
    target: str,
    feature_columns: Sequence[str],
    task: str = "classification",
    algorithm: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Importances of the best model, and its test rows with their contributions."""
    runs = {"classification": run_classification, "regression": run_regression}
    if task not in runs:
        raise ValueError(f"Unknown task '{task}'")
    found = runs[task](df, target, feature_columns, algorithm, cross_validate=False)
    return found.importances, found.scored
