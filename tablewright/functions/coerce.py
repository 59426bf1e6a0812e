"""Column coercion: numbers, timestamps, labels, and argument checks.

Every expression here is a built-in Spark expression, so it stays in
whole-stage codegen and never raises under ANSI mode: a value that does not
convert becomes NULL, and NaN becomes NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_LABEL = "Missing"

# Text accepted as a number. Plain casts also take Java suffixes such as "1d".
_NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

# Shapes of the date part of a text, and the same date as year-month-day. "|" ends the date part.
# A month's name is taken as it is; one that repeats its first letters ("MayMay") is none.
_NAME = r"(?!(?i:(?<twice>[a-z]{3})[a-z]*\k<twice>))(?<month>[A-Za-z]{3,9})"
DATE_SHAPES = (
    r"^(?<year>\d{4})(?<mark>[/-])(?<month>\d{1,2})\k<mark>(?<day>\d{1,2})(?=\|)",
    r"^(?<year>\d{4})(?<month>\d{2})(?<day>\d{2})(?=\|)",
    r"^(?<month>\d{1,2})(?<mark>[/-])(?<day>\d{1,2})\k<mark>(?<year>\d{4})(?=\|)",
    r"^(?<day>\d{1,2})\.(?<month>\d{1,2})\.(?<year>\d{4})(?=\|)",
    rf"^{_NAME} (?<day>\d{{1,2}}),? (?<year>\d{{4}})(?=\|)",
    rf"^(?<day>\d{{1,2}})[ -]{_NAME}[ -](?<year>\d{{4}})(?=\|)",
)
# Two-digit years from 69 on belong to the century before.
_SHORT_YEAR = r"^(?<rest>\d{1,2}/\d{1,2}/|\d{1,2}[ -][A-Za-z]{3}[ -])"
CENTURIES = {r"(?=(?:[0-5]\d|6[0-8])\|)": "20", r"(?=(?:69|[7-9]\d)\|)": "19"}
_SPELLED_LAYOUT = "yyyy-[MMMM][MMM][M]-d'|'[h:mm:[ss]'|'a][H:mm:[ss]'|'][::'|']X"
_ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
_ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?(Z|[+-]\d{2}:?\d{2})$"
_CLOCK = r"^(.*?)(?:,?[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)? ?([AaPp][Mm])?)?$"


def ref(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Column '{missing[0]}' does not exist")


def require_rows(df: DataFrame, message: str) -> None:
    """Raise when ``df`` has no row; reads only until the first row is found."""
    if df.isEmpty():
        raise ValueError(message)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; anything that is not a number is NULL."""
    col, dtype = ref(name), data_type(df, name)
    if is_text(dtype):
        value = F.when(col.rlike(_NUMBER_TEXT), F.trim(col).try_cast("double"))
    elif isinstance(dtype, T.BooleanType):
        value = col.cast("int").cast("double")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(col), col.cast("double"))
    elif is_numeric(dtype):
        value = col.cast("double")
    else:
        value = F.lit(None).cast("double")
    return value


def timestamp(df: DataFrame, name: str) -> Column:
    """The column as TIMESTAMP_NTZ; text that is not a full date is NULL.

    Text with an offset is converted to UTC, so that mixed zones keep their order.
    """
    col, dtype = ref(name), data_type(df, name)
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if is_temporal(dtype):
        return col.cast("timestamp_ntz")
    if is_text(dtype):
        trimmed = F.regexp_replace(col, r"^\s+|\s+$", "")
        return F.when(
            trimmed.rlike(r"^[0-9A-Za-z].*\d"),  # keeps the patterns away from other text
            F.when(trimmed.rlike(_ISO_TEXT), trimmed.try_cast("timestamp_ntz"))
            .when(trimmed.rlike(_ISO_OFFSET), _utc(trimmed.try_cast("timestamp")))
            .otherwise(_spelled(trimmed)),
        )
    if is_numeric(dtype):  # nanoseconds since the epoch
        micros = F.floor(number(df, name) / F.lit(1000.0))
        return F.timestamp_micros(micros).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def _utc(instant: Column) -> Column:
    """The UTC clock time of an instant, whatever the session's zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _spelled(value: Column) -> Column:
    """A date in one of ``DATE_SHAPES``, with or without a 12 or 24 hour clock.

    Each step rewrites the text of the step before, and one parse ends the chain, so the
    expression names ``value`` once and the code made for it stays small.
    """
    found = F.regexp_replace(value, _CLOCK, "$1|$2:$3:$4|$5")
    for years, century in CENTURIES.items():
        found = F.regexp_replace(found, _SHORT_YEAR + years, "${rest}" + century)
    for shape in DATE_SHAPES:
        found = F.regexp_replace(found, shape, "${year}-${month}-${day}")
    return _utc(F.try_to_timestamp(F.concat(found, F.lit("Z")), F.lit(_SPELLED_LAYOUT)))


def day_of(ts: Column) -> Column:
    """Midnight of the day of a TIMESTAMP_NTZ."""
    return ts.cast("date").cast("timestamp_ntz")


def text(df: DataFrame, name: str) -> Column:
    """The column as text, NULL kept; -0.0 reads as 0.0 and booleans as True/False."""
    col, dtype = ref(name), data_type(df, name)
    if isinstance(dtype, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), (col + F.lit(0.0).cast(dtype)).cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    if isinstance(dtype, T.TimestampType):
        # In the hour that a clock change repeats, the later instant shows its offset.
        later = col.cast("timestamp_ntz").cast("timestamp") != col
        return F.when(later, F.concat(col.cast("string"), F.date_format(col, " XXX"))).otherwise(
            col.cast("string")
        )
    return col.cast("string")


def has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(has_map(f.dataType) for f in dtype.fields)


def groupable(df: DataFrame, name: str) -> Column:
    """The column's own value in a form that groups and hashes; equal exactly when rows count as equal.

    NaN is NULL and -0.0 is 0.0. Maps compare by their entries in key order.
    """
    col, dtype = ref(name), data_type(df, name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col + F.lit(0.0).cast(dtype))
    if isinstance(dtype, T.MapType) and not has_map(dtype.keyType) and not has_map(dtype.valueType):
        return F.array_sort(F.map_entries(col))
    return F.to_json(col) if has_map(dtype) else col


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is NULL or NaN."""
    col = ref(name)
    if isinstance(data_type(df, name), (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floats = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(ref(n)), ref(n)).alias(n) if n in floats else ref(n)
            for n in df.columns
        ]
    )


def label(value: Column) -> Column:
    """Display text of a dimension value. Apply after grouping, never before."""
    return F.coalesce(value, F.lit(MISSING_LABEL))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (row, column): ``column``, ``value`` text, ``number`` sort key.

    ``number`` is filled for numeric columns only and is a function of
    ``value``, so grouping by all three equals grouping by (column, value).
    """
    require_columns(df, columns)
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            text(df, name).alias("value"),
            (
                number(df, name)
                if is_numeric(data_type(df, name))
                else F.lit(None).cast("double")
            ).alias("number"),
        )
        for name in columns
    ]
    return df.select(F.inline(F.array(*cells)))
