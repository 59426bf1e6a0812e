"""Feature screening, encoding, and exact train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.durable import written
from tablewright.functions.coerce import (
    is_temporal,
    is_text,
    missing,
    number,
    ref,
    require_columns,
    text,
)
from tablewright.functions.joins import join_null_safe
from tablewright.operators.ordering import with_row_number
from tablewright.operators.profile import Profile, distinct_counts
from tablewright.operators.quantiles import column_quantiles

# Limits of the feature rules.
MAX_CATEGORIES = 50
MIN_ROWS = 10
UNKNOWN = "Unknown"
# Bins of a feature of boosted trees, as many as Spark's tree learners make by default.
MAX_BINS = 32
SEED = 42
# Above this an approximate count settles that a column has too many categories.
_CLEARLY_TOO_MANY = 4 * MAX_CATEGORIES
# Label maps up to this size are held by StringIndexer; larger ones are joined.
INDEXED_LABELS = 10_000


def default_features(profiled: Profile, target: str | None) -> list[str]:
    return [
        c for c in profiled.numerical_columns + profiled.categorical_columns if c != target
    ]


def recommended_tasks(profiled: Profile) -> list[str]:
    """Tasks the columns of a table allow."""
    numeric, several = profiled.numerical_columns, len(profiled.numerical_columns) >= 2
    tasks = {
        "forecasting": bool(profiled.datetime_columns and numeric),
        "classification": bool(profiled.categorical_columns),
        "regression": several,
        "clustering": several,
    }
    return [task for task, fits in tasks.items() if fits]


def check_training_input(df: DataFrame, target: str, features: Sequence[str]) -> int:
    """Row count of a table that can be trained on."""
    if not target:
        raise ValueError("a target column is needed")
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    if not features:
        raise ValueError("at least one feature is needed")
    rows = df.count()
    if rows == 0:
        raise ValueError("the table is empty")
    if rows < MIN_ROWS:
        raise ValueError(f"training needs at least {MIN_ROWS} rows, found {rows}")
    return rows


def screen_features(
    df: DataFrame, target: str | None, features: Sequence[str], rows: int
) -> tuple[list[str], list[str]]:
    """Usable features and a warning for each dropped one."""
    reasons: dict[str, str] = {}
    for c in features:
        if c == target:
            reasons[c] = "it is the target, which would leak into the features"
        elif c not in df.columns:
            reasons[c] = "there is no such column"
        elif is_temporal(df.schema[c].dataType):
            reasons[c] = "dates are not numbers or categories"
    left = [c for c in features if c not in reasons]
    texts = [c for c in left if is_text(df.schema[c].dataType)]
    if left:
        facts = df.agg(
            *[
                (F.min(text(df, c)).eqNullSafe(F.max(text(df, c)))).alias(f"constant{i}")
                for i, c in enumerate(left)
            ],
            *[F.approx_count_distinct(ref(c)).alias(f"about{i}") for i, c in enumerate(texts)],
        ).first()
        for i, c in enumerate(left):
            if facts[f"constant{i}"]:
                reasons[c] = "it has a single value"
        limit = min(MAX_CATEGORIES, max(1, rows // 2))
        about = {c: facts[f"about{i}"] for i, c in enumerate(texts)}
        close = [c for c in texts if c not in reasons and about[c] <= _CLEARLY_TOO_MANY]
        exact = (
            {r["column"]: r["unique_count"] for r in distinct_counts(df, close).collect()}
            if close
            else {}
        )
        for c in texts:
            if c not in reasons and exact.get(c, about[c]) > limit:
                reasons[c] = "it has too many categories and looks like an identifier"
    clean = [c for c in features if c not in reasons]
    warnings = [f"Dropped '{c}': {reasons[c]}" for c in features if c in reasons]
    if not clean:
        raise ValueError("No usable feature: " + "; ".join(warnings))
    return clean, warnings


def _joined_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Alphabetical codes by a join: the label map never leaves the executors."""
    labels = df.select(ref(column).alias("_label")).distinct()
    codes = with_row_number(labels, [F.col("_label")], name="_code").select(
        F.col("_label").alias(column), (F.col("_code") - 1).cast("double").alias(out)
    )
    return join_null_safe(df, codes, [column])


def encode_features(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric feature columns ``f0..fk`` beside the table's own columns.

    Text gets alphabetical codes, missing text the code of "Unknown"; missing
    numbers get the column median, or 0 when there is none.
    """
    require_columns(df, features)
    for c in features:
        if is_temporal(df.schema[c].dataType):
            raise ValueError(f"datetime column '{c}' cannot be a feature")
    texts = [c for c in features if not _is_number(df.schema[c].dataType)]
    numbers = [c for c in features if c not in texts]
    medians: dict[str, float] = {}
    if numbers:
        gaps = df.agg(
            *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(numbers)]
        ).first()
        with_gaps = [c for i, c in enumerate(numbers) if gaps[f"m{i}"]]
        if with_gaps:
            found = column_quantiles(df, with_gaps, [0.5])
            medians = {c: found[c][0] if found[c] else 0.0 for c in with_gaps}
    names = [f"f{i}" for i in range(len(features))]
    columns: list[Column] = []
    for name, c in zip(names, features):
        if c in texts:
            columns.append(F.coalesce(text(df, c), F.lit(UNKNOWN)).alias(f"_text_{name}"))
        else:
            columns.append(F.coalesce(number(df, c), F.lit(medians.get(c, 0.0))).alias(name))
    encoded = df.select("*", *columns)
    coded = {f"_text_{n}": n for n, c in zip(names, features) if c in texts}
    if coded:
        sizes = encoded.agg(*[F.approx_count_distinct(s).alias(s) for s in coded]).first()
        small = {s: n for s, n in coded.items() if sizes[s] <= INDEXED_LABELS}
        if small:
            indexer = StringIndexer(
                inputCols=list(small),
                outputCols=list(small.values()),
                stringOrderType="alphabetAsc",
                handleInvalid="error",
            )
            encoded = indexer.fit(encoded).transform(encoded)
        for s, n in coded.items():
            if s not in small:
                encoded = _joined_codes(encoded, s, n)
        # Codes are ordinals here, so the nominal metadata is dropped.
        encoded = encoded.drop(*coded).withColumns(
            {n: F.col(n) + F.lit(0.0) for n in coded.values()}
        )
    return encoded, names


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def assemble(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the ``features`` vector."""
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


def bin_borders(df: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    """Upper ends of each feature's bins but the last: at most ``MAX_BINS`` bins.

    Up to ``MAX_BINS`` distinct values have a bin each; more are cut at exact
    quantiles. All comes from the feature alone, over all rows.
    """
    sizes = df.agg(*[F.approx_count_distinct(ref(n)).alias(n) for n in names]).first()
    borders, many = {}, []
    for n in names:
        values = []
        if sizes[n] <= 2 * MAX_BINS:  # the count is approximate
            values = [r[0] for r in df.select(ref(n)).distinct().limit(MAX_BINS + 1).collect()]
        if 0 < len(values) <= MAX_BINS:
            ends = sorted(values)
            borders[n] = [a / 2 + b / 2 for a, b in zip(ends, ends[1:])]
        else:
            many.append(n)
    if many:
        shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
        borders.update({n: sorted(set(q or [])) for n, q in column_quantiles(df, many, shares).items()})
    return borders


def binned(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds ``bin_<name>`` for each feature, and the vector ``binned`` of them.

    The borders come from the training rows.
    """
    borders = bin_borders(table.where(~F.col("is_test")), names)

    def place(n: str) -> Column:
        ends = F.array(*[F.lit(float(x)) for x in borders[n]]).cast("array<double>")
        return F.size(F.filter(ends, lambda end: end < ref(n))).cast("double")

    found = table.withColumns({f"bin_{n}": place(n) for n in names})
    return VectorAssembler(inputCols=[f"bin_{n}" for n in names], outputCol="binned").transform(found)


def with_split(
    df: DataFrame, folds: int, stratify_by: str | None = None, test_share: float = 0.2
) -> DataFrame:
    """Adds ``is_test`` and ``fold``, exact per class, and stores the table.

    Rows are ranked inside each class by a hash of the row. The ranks come
    from range-partitioned slices, so a class with a third of all rows does
    not end up in one task. Training reads the stored copy many times.
    """
    hashed = df.withColumn("_draw", F.xxhash64(*[ref(c) for c in df.columns], F.lit(SEED)))
    ranked = with_row_number(
        hashed, [F.col("_draw")], [stratify_by] if stratify_by else [], name="draw_rank"
    )
    train = F.greatest(F.lit(1), F.floor(F.col("draw_rank_total") * (1 - test_share)))
    return written(
        ranked.select(
            *[ref(c) for c in df.columns],
            "draw_rank",
            (F.col("draw_rank") > train).alias("is_test"),
            F.pmod(F.col("draw_rank") - 1, F.lit(max(folds, 1))).cast("int").alias("fold"),
        )
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class of the target, missing ones as "Unknown"."""
    return df.groupBy(F.coalesce(text(df, target), F.lit(UNKNOWN)).alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )
