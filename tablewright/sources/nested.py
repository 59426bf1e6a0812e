"""Nested JSON to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.coerce import ref, require_columns, require_rows


def _at_path(dtype: T.DataType, path: str | None, root: Column) -> tuple[T.DataType, Column]:
    for part in path.split(".") if path else []:
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            raise ValueError(f"the data has no path '{path}'")
        root, dtype = root.getField(part), dtype[part].dataType
    return dtype, root


def _leaves(dtype: T.StructType, root: Column, prefix: str = "") -> list[Column]:
    """Every non-struct field as a column with a dotted name; arrays stay values."""
    out = []
    for field in dtype.fields:
        value, name = root.getField(field.name), prefix + field.name
        if isinstance(field.dataType, T.StructType):
            out += _leaves(field.dataType, value, name + ".")
        else:
            out.append(value.alias(name))
    return out


def flatten(df: DataFrame, column: str, json_path: str | None = None) -> DataFrame:
    """Records at ``json_path`` of a struct or array column, nested names dotted.

    An array gives one row per element, an object one row. Row-local: no
    shuffle, whatever the size.
    """
    require_columns(df, [column])
    dtype, node = _at_path(df.schema[column].dataType, json_path, ref(column))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        rows = df.select(F.explode(node).alias("record"))
        dtype = dtype.elementType
    elif isinstance(dtype, T.StructType):
        rows = df.select(node.alias("record")).where(F.col("record").isNotNull())
    else:
        raise ValueError("expected a JSON object or an array of objects")
    return _flat(rows, [], dtype)


def _flat(rows: DataFrame, keep: list[str], dtype: T.StructType) -> DataFrame:
    """``rows`` with the leaves of ``record`` beside ``keep``; every name once."""
    found = rows.select(*[ref(c) for c in keep], *_leaves(dtype, F.col("record")))
    twice = sorted({c for c in found.columns if found.columns.count(c) > 1})
    if twice:
        raise ValueError(f"two fields flatten to the same name: {', '.join(twice)}")
    return found


def read_json(
    spark: SparkSession,
    path: str,
    json_path: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Landed JSON as a flat table.

    Line-delimited files split across tasks; ``multi_line`` reads each file
    whole, for documents that span lines.
    """
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.json(path)
    flat = flatten(
        raw.select(F.struct(*[ref(c) for c in raw.columns]).alias("document")),
        "document",
        json_path,
    )
    if limit is not None:
        flat = flat.limit(limit)
    require_rows(flat, "the JSON source has no records")
    return flat


def json_column_schema(df: DataFrame, column: str) -> str:
    """DDL of the JSON texts in a column, merged over the whole table on executors."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(ref(column)))).first()[0]
    if found is None or not found.startswith(("OBJECT", "ARRAY")):
        raise ValueError(f"Column '{column}' holds no JSON objects")
    return found.replace("OBJECT<", "STRUCT<")


def flatten_json_column(
    df: DataFrame,
    column: str,
    json_path: str | None = None,
    schema: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """JSON text parsed and flattened; ``keep`` repeats other columns beside it."""
    require_columns(df, [column, *(keep or [])])
    ddl = schema or json_column_schema(df, column)
    parsed = F.from_json(ref(column), F.lit(ddl))
    if not keep:
        return flatten(df.select(parsed.alias("document")), "document", json_path)
    typed = df.select(*[ref(c) for c in keep], parsed.alias("document"))
    dtype, node = _at_path(typed.schema["document"].dataType, json_path, F.col("document"))
    if isinstance(dtype, T.ArrayType):
        if not isinstance(dtype.elementType, T.StructType):
            raise ValueError("expected a JSON object or an array of objects")
        typed = typed.select(*[ref(c) for c in keep], F.explode(node).alias("record"))
        dtype = dtype.elementType
    elif isinstance(dtype, T.StructType):
        typed = typed.select(*[ref(c) for c in keep], node.alias("record"))
    else:
        raise ValueError("expected a JSON object or an array of objects")
    return _flat(typed, keep, dtype)
