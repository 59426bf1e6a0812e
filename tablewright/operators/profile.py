"""What a table holds: types, missing values, distinct values, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.durable import written
from tablewright.functions.coerce import (
    groupable,
    is_numeric,
    is_temporal,
    is_text,
    long_form,
    missing,
    ref,
    require_columns,
    require_rows,
    text,
    timestamp,
)

# Thresholds of the type inference.
DATE_SHARE = 0.7
CODE_DISTINCT = 15
CODE_SHARE = 0.05
CATEGORY_DISTINCT = 20
CATEGORY_SHARE = 0.05
CATEGORY_LENGTH = 50
SAMPLE_VALUES = 5
# Repeated row hashes up to this number are broadcast (8 bytes each).
BROADCAST_HASHES = 500_000
NESTED = (T.ArrayType, T.MapType, T.StructType)


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: str
    inferred_type: str
    missing_count: int
    missing_pct: float
    unique_count: int
    sample_values: list[str]


@dataclass(frozen=True)
class Profile:
    row_count: int
    duplicate_count: int
    columns: list[ColumnProfile]

    @property
    def column_count(self) -> int:
        return len(self.columns)

    @property
    def missing_cells(self) -> int:
        return sum(c.missing_count for c in self.columns)

    @property
    def missing_pct(self) -> float:
        cells = self.row_count * self.column_count
        return round(self.missing_cells / cells * 100, 2) if cells else 0.0

    def of_type(self, *types: str) -> list[str]:
        return [c.name for c in self.columns if c.inferred_type in types]

    @property
    def numerical_columns(self) -> list[str]:
        return self.of_type("numerical")

    @property
    def categorical_columns(self) -> list[str]:
        return self.of_type("categorical", "boolean")

    @property
    def datetime_columns(self) -> list[str]:
        return self.of_type("datetime")

    @property
    def text_columns(self) -> list[str]:
        return self.of_type("text")

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per column."""
        schema = (
            "name string, dtype string, inferred_type string, missing_count long, "
            "missing_pct double, unique_count long, sample_values array<string>"
        )
        rows = [
            (
                c.name,
                c.dtype,
                c.inferred_type,
                c.missing_count,
                c.missing_pct,
                c.unique_count,
                c.sample_values,
            )
            for c in self.columns
        ]
        return spark.createDataFrame(rows, schema)

    def summary_df(self, spark: SparkSession) -> DataFrame:
        """The nine headline figures as (metric, value) rows."""
        rows = [
            ("Total Rows", float(self.row_count)),
            ("Total Columns", float(self.column_count)),
            ("Duplicate Rows", float(self.duplicate_count)),
            ("Missing Cells", float(self.missing_cells)),
            ("Missing Percentage", self.missing_pct),
            ("Numerical Columns", float(len(self.numerical_columns))),
            ("Categorical Columns", float(len(self.categorical_columns))),
            ("Datetime Columns", float(len(self.datetime_columns))),
            ("Text Columns", float(len(self.text_columns))),
        ]
        return spark.createDataFrame(rows, "metric string, value double")


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, missing_count, total_rows for every column, in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(c).alias("column"),
                        F.col(f"m{i}").alias("missing_count"),
                    )
                    for i, c in enumerate(df.columns)
                ]
            )
        ),
        "total_rows",
    ).select("position", "column", "missing_count", "total_rows")


def most_missing(df: DataFrame, k: int = 10) -> DataFrame:
    """Columns with missing values, most affected first."""
    return (
        missing_by_column(df)
        .where("missing_count > 0")
        .orderBy(F.col("missing_count").desc(), "position")
        .limit(k)
        .select("column", "missing_count")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each distinct row, and all rows.

    The first shuffle carries one 8-byte hash per distinct row. Whole rows are
    grouped only where the hash repeats, so the count is exact and a table
    without duplicates never shuffles its rows. Copies collapse on the map
    side in either shuffle.
    """
    spark = df.sparkSession
    schema = "duplicate_rows long, total_rows long"
    rows = df.select(*[groupable(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    hashes = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    repeated = written(hashes.where("_n > 1"))
    facts = repeated.agg(F.count(F.lit(1)).alias("hashes")).first()
    total = rows.count()
    if not facts["hashes"]:
        return spark.createDataFrame([(0, total)], schema)
    wanted = repeated.select("_hash")
    if facts["hashes"] <= BROADCAST_HASHES:
        wanted = F.broadcast(wanted)  # else both sides are shuffled by the hash
    suspects = hashed.join(wanted, "_hash", "left_semi")
    copies = suspects.groupBy("_hash", *rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.lit(total).cast("long").alias("total_rows"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, unique_count and the smallest distinct values as samples.

    One shuffle on (column, value) after map-side grouping: a frequent value
    is one row per task, and no column is gathered in one place.
    """
    values = (
        long_form(df, list(columns))
        .na.drop(subset=["value"])
        .groupBy("column", "value", "number")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    counts = values.groupBy("column").agg(F.count("value").alias("unique_count"))
    smallest = Window.partitionBy("column").orderBy("number", "value")
    samples = (
        values.select("column", "value", F.row_number().over(smallest).alias("rank"))
        .where(F.col("rank") <= SAMPLE_VALUES)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
        .select("column", F.col("ranked.value").alias("sample_values"))
    )
    return counts.join(samples, "column")


def _semantic_type(
    dtype: T.DataType, rows: int, distinct: int, date_share: float, length: float
) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_temporal(dtype):
        return "datetime"
    if is_numeric(dtype):
        coded = distinct <= CODE_DISTINCT and distinct / max(rows, 1) < CODE_SHARE
        return "categorical" if isinstance(dtype, T.IntegralType) and coded else "numerical"
    if date_share > DATE_SHARE:
        return "datetime"
    few = distinct <= max(CATEGORY_DISTINCT, int(CATEGORY_SHARE * rows))
    return "categorical" if few and length < CATEGORY_LENGTH else "text"


def _column_facts(df: DataFrame, names: Sequence[str]) -> dict:
    """Row count, missing counts, text lengths and date parse counts, one pass."""
    folds = []
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        folds.append(F.count_if(missing(df, name)).alias(f"m{i}"))
        if not (is_numeric(dtype) or is_temporal(dtype) or isinstance(dtype, T.BooleanType)):
            folds.append(F.avg(F.length(text(df, name))).alias(f"l{i}"))
            parsed = timestamp(df, name) if is_text(dtype) else F.lit(None)
            folds.append(F.count(parsed).alias(f"d{i}"))
    return df.agg(F.count(F.lit(1)).alias("rows"), *folds).first().asDict()


def _types(
    df: DataFrame, names: Sequence[str], facts: dict, unique: dict[str, int]
) -> dict[str, str]:
    return {
        name: _semantic_type(
            df.schema[name].dataType,
            facts["rows"],
            unique.get(name, 0),
            facts.get(f"d{i}", 0) / max(facts["rows"], 1),
            facts.get(f"l{i}") or 0.0,
        )
        for i, name in enumerate(names)
    }


def inferred_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Semantic type per column.

    Distinct values are counted exactly only where an approximate count is
    within a factor of two of the threshold that decides the type.
    """
    require_columns(df, columns)
    facts = _column_facts(df, columns)
    return _types(df, columns, facts, _unique_for_types(df, _undecided(df, columns), facts["rows"]))


def _undecided(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose type depends on how many distinct values they have."""
    return [
        c
        for c in columns
        if not isinstance(df.schema[c].dataType, (T.BooleanType, T.FractionalType))
        and not is_temporal(df.schema[c].dataType)
    ]


def _unique_for_types(df: DataFrame, columns: Sequence[str], rows: int) -> dict[str, int]:
    """Approximate distinct counts, exact where the type could depend on the error."""
    if not columns:
        return {}
    about = df.agg(
        *[F.approx_count_distinct(text(df, c), 0.02).alias(f"u{i}") for i, c in enumerate(columns)]
    ).first()
    unique = {c: about[f"u{i}"] for i, c in enumerate(columns)}
    close = [c for c in columns if _near_threshold(df, c, unique[c], rows)]
    if close:
        exact = {r["column"]: r["unique_count"] for r in distinct_counts(df, close).collect()}
        unique.update({c: exact.get(c, 0) for c in close})
    return unique


def _near_threshold(df: DataFrame, column: str, about: int, rows: int) -> bool:
    if is_numeric(df.schema[column].dataType):
        limits = (CODE_DISTINCT, CODE_SHARE * rows)
    else:
        limits = (max(CATEGORY_DISTINCT, CATEGORY_SHARE * rows),)
    return any(limit / 2 <= about <= limit * 2 for limit in limits)


def profile(
    df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool | None = True
) -> Profile:
    """Counts and semantic type of every column; only scalars reach the driver.

    Exact distinct counts shuffle every distinct value. Without
    ``exact_distinct`` they are within about 2 % and need no shuffle, types
    stay exact, and the samples are the smallest and the largest value. With
    None, they are counted only for columns whose type depends on them, and there
    are no samples; types, gaps and duplicates are exact in any case.
    """
    names = list(columns or df.columns)
    require_columns(df, names)
    facts = _column_facts(df, names)
    rows = facts["rows"]
    if exact_distinct:
        found = distinct_counts(df, names).collect()
        unique = {r["column"]: r["unique_count"] for r in found}
        samples = {r["column"]: list(r["sample_values"]) for r in found}
    else:
        unique = _unique_for_types(df, _undecided(df, names) if exact_distinct is None else names, rows)
        samples = {} if exact_distinct is None else _extremes(df, names)
    types = _types(df, names, facts, unique)
    duplicates = duplicate_count(df.select(*[ref(c) for c in names])).first()
    return Profile(
        rows,
        duplicates["duplicate_rows"],
        [
            ColumnProfile(
                name=name,
                dtype=df.schema[name].dataType.simpleString(),
                inferred_type=types[name],
                missing_count=facts[f"m{i}"],
                missing_pct=round(facts[f"m{i}"] / rows * 100, 2) if rows else 0.0,
                unique_count=unique.get(name, 0),
                sample_values=samples.get(name, []),
            )
            for i, name in enumerate(names)
        ],
    )


def _extremes(df: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """Smallest and largest value per column as text, in one pass."""
    row = df.agg(
        *[
            f(text(df, c) if isinstance(df.schema[c].dataType, NESTED) else ref(c))
            .cast("string")
            .alias(f"{end}{i}")
            for i, c in enumerate(names)
            for end, f in (("lo", F.min), ("hi", F.max))
        ]
    ).first()
    ends = {c: [row[f"lo{i}"], row[f"hi{i}"]] for i, c in enumerate(names)}
    return {
        c: [v for v in dict.fromkeys(values) if v is not None] for c, values in ends.items()
    }


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: counts, column lists by data type, duplicates, missing values."""
    require_rows(df, "Dataset is empty")
    fields = df.schema.fields
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    categorical = [
        f.name for f in fields if is_text(f.dataType) or isinstance(f.dataType, T.BooleanType)
    ]
    gaps = missing_by_column(df).agg(
        F.first("total_rows").alias("row_count"),
        F.sum("missing_count").alias("missing_cells"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("missing_count") > 0, F.struct("column", "missing_count")))
        ).alias("missing_by_column"),
    )
    duplicates = duplicate_count(df).first()["duplicate_rows"]
    return gaps.select(
        "row_count",
        F.lit(len(fields)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.array(*[F.lit(c) for c in numeric]).cast("array<string>").alias("numeric_columns"),
        F.array(*[F.lit(c) for c in categorical])
        .cast("array<string>")
        .alias("categorical_columns"),
        F.lit(duplicates).cast("long").alias("duplicate_rows"),
        "missing_cells",
        "missing_by_column",
    )


def completeness(df: DataFrame) -> DataFrame:
    """Share of filled cells and its band."""
    cells = missing_by_column(df).agg(
        F.sum("missing_count").alias("missing_cells"),
        F.sum("total_rows").alias("total_cells"),
    )
    share = F.lit(100.0) - F.round(
        F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("total_cells")), F.lit(0.0)),
        2,
    )
    return cells.select("missing_cells", "total_cells", share.alias("completeness")).select(
        "*",
        F.when(F.col("completeness") >= 95, "Excellent")
        .when(F.col("completeness") >= 90, "Good")
        .when(F.col("completeness") >= 75, "Moderate")
        .otherwise("Needs Attention")
        .alias("assessment"),
    )


def cleaning_suggestions(profiled: Profile, spark: SparkSession) -> DataFrame:
    """column, issue, suggestion for every column with missing values."""
    # Advice per semantic type.
    advice = {
        "numerical": "Impute with median (robust to outliers).",
        "categorical": "Impute with the most frequent category (mode).",
        "boolean": "Impute with the most frequent category (mode).",
        "datetime": "Forward-fill or drop rows, depending on whether the series is sequential.",
        "text": "Fill with a placeholder ('Unknown') or drop rows.",
    }
    kind = F.create_map(*[F.lit(x) for pair in advice.items() for x in pair])
    columns = profiled.to_df(spark).where("missing_pct > 0")
    per_column = columns.select(
        F.col("name").alias("column"),
        F.concat(F.col("missing_pct").cast("string"), F.lit("% missing values")).alias("issue"),
        F.when(
            F.col("missing_pct") > 50,
            "Consider dropping this column — over half its values are missing.",
        )
        .otherwise(kind[F.col("inferred_type")])
        .alias("suggestion"),
    )
    if not profiled.duplicate_count:
        return per_column
    whole = spark.createDataFrame(
        [
            (
                "__all__",
                f"{profiled.duplicate_count} duplicate rows detected",
                "Drop exact duplicate rows.",
            )
        ],
        per_column.schema,
    )
    return per_column.unionByName(whole)
