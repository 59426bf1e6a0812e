"""Files, named datasets with a raw and a clean version, and ingest."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.coerce import (
    is_text,
    nan_to_null,
    number,
    ref,
    require_rows,
    timestamp,
)
from tablewright.operators.profile import DATE_SHARE, Profile, profile
from tablewright.sources.quoted import records

_DATASET_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
# Texts that stand for a missing value in CSV files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_EXTRA = "__extra_field"
_WHOLE = r"^[+-]?\d+$"
_TRUTH = ("true", "false")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    malformed: str = "raise",
) -> DataFrame:
    """CSV with a header; quotes inside quotes are doubled, and missing tokens are NULL.

    Without a schema one aggregate over all cells types the columns: whole
    numbers, numbers, booleans, ISO dates and timestamps, else text. With a
    schema, columns are taken in its order and cells that don't convert are NULL.

    ``multi_line`` says whether quoted cells may hold line breaks; None looks
    first whether any line leaves a quote open. Such files are split at records
    (``sources.quoted``); only where quotes stand inside unquoted cells, or a
    file ends inside quotes, is each file read by one task.
    Records with more cells than the header are malformed: they ``raise``, or are
    left out with ``malformed="drop"``. Shorter records end in NULLs.
    """
    if malformed not in ("raise", "drop"):
        raise ValueError("malformed must be 'raise' or 'drop'")
    open_quotes = 0
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        broken = spark.read.text(path).where(F.pmod(quotes, F.lit(2)) == 1)
        open_quotes = broken.limit(1).count()
    if multi_line is None:
        multi_line = bool(open_quotes)
    elif open_quotes and not multi_line:
        raise ValueError("a quoted cell holds a line break; read the file with multi_line=True")
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("maxCharsPerColumn", -1)
    )
    names = reader.csv(path).columns
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = wanted.fieldNames() + names[len(wanted) :]
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _EXTRA]])
    whole = records(spark, path) if multi_line else None
    if whole is not None:
        options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
        cells = whole.select(F.from_csv("record", F.lit(texts.toDDL()), options).alias("cells")).select("cells.*")
    else:
        cells = reader.option("enforceSchema", True).schema(texts).csv(path)
    if malformed == "raise":
        longer = cells.where(ref(_EXTRA).isNotNull()).limit(1).count()
        if longer:
            raise ValueError(f"a record of {path} has more cells than the header")
    cells = cells.where(ref(_EXTRA).isNull()).select(
        *[F.when(~ref(c).isin(*MISSING_TEXTS), ref(c)).alias(c) for c in names]
    )
    if schema is not None:
        return cells.select(*[_cell(f.name, f.dataType).alias(f.name) for f in wanted.fields])
    kinds = _cell_types(cells)
    return cells.select(*[_cell(c, kinds[c]).alias(c) for c in cells.columns])


def _cell(name: str, kind: T.DataType) -> Column:
    """A text cell as ``kind``, NULL where it does not convert."""
    if is_text(kind):
        return ref(name).cast(kind)
    return F.trim(ref(name)).try_cast(kind)


def _cell_types(cells: DataFrame) -> dict[str, T.DataType]:
    """The narrowest type that all filled cells of each column convert to, in one pass."""
    folds = []
    for i, name in enumerate(cells.columns):
        value = F.trim(ref(name))
        whole = value.rlike(_WHOLE)
        tests = {
            "n": ref(name).isNotNull(),
            "int": whole & value.try_cast("int").isNotNull(),
            "long": whole & value.try_cast("bigint").isNotNull(),
            "double": number(cells, name).isNotNull(),
            "truth": F.lower(value).isin(*_TRUTH),
            "date": value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull(),
            "time": value.rlike(r"^\d{4}-\d{2}-\d{2}") & value.try_cast("timestamp").isNotNull(),
        }
        folds += [F.count_if(test).alias(f"{kind}{i}") for kind, test in tests.items()]
    row = cells.agg(*folds).first()
    order = (
        ("int", T.IntegerType()),
        ("long", T.LongType()),
        ("double", T.DoubleType()),
        ("truth", T.BooleanType()),
        ("date", T.DateType()),
        ("time", T.TimestampType()),
    )
    return {
        name: next(
            (kind for test, kind in order if row[f"n{i}"] and row[f"{test}{i}"] == row[f"n{i}"]),
            T.StringType(),
        )
        for i, name in enumerate(cells.columns)
    }


@dataclass(frozen=True)
class DatasetStore:
    """Datasets below one folder, each with a ``raw`` and maybe a ``clean`` version."""

    spark: SparkSession
    root: str

    def path(self, name: str, cleaned: bool) -> str:
        if not _DATASET_NAME.fullmatch(name):
            raise ValueError(f"Invalid dataset name: {name!r}")
        return f"{self.root.rstrip('/')}/{name}/{'clean' if cleaned else 'raw'}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(target)

    def save(self, name: str, df: DataFrame, cleaned: bool = False) -> None:
        df.write.mode("overwrite").parquet(self.path(name, cleaned))

    def load(self, name: str, cleaned: bool = True) -> DataFrame:
        """The clean version where there is one and it is wanted, else the raw one."""
        for version in (True, False) if cleaned else (False,):
            path = self.path(name, version)
            if self._exists(path):
                return self.spark.read.parquet(path)
        raise FileNotFoundError(f"Dataset {name} not found")


def normalised(df: DataFrame, source_label: str = "table") -> DataFrame:
    """Trimmed column names, NaN as NULL, and date-like text as timestamps.

    A text column becomes a timestamp when more than 70 % of all rows parse;
    all columns are judged in one pass.
    """
    require_rows(df, f"nothing to import from '{source_label}'")
    named = nan_to_null(df.toDF(*[c.strip() for c in df.columns]))
    texts = [f.name for f in named.schema.fields if is_text(f.dataType)]
    if not texts:
        return named
    shares = named.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(timestamp(named, c)).alias(f"d{i}") for i, c in enumerate(texts)],
    ).first()
    dates = {
        c for i, c in enumerate(texts) if shares[f"d{i}"] / shares["rows"] > DATE_SHARE
    }
    return named.select(
        *[timestamp(named, c).alias(c) if c in dates else ref(c) for c in named.columns]
    )


def ingest(
    store: DatasetStore, name: str, df: DataFrame, source_label: str | None = None
) -> Profile:
    """Normalise, save as the raw version, and profile what was saved."""
    store.save(name, normalised(df, source_label or name))
    return profile(store.load(name, cleaned=False))


def import_table(
    store: DatasetStore,
    name: str,
    fetched: DataFrame,
    source: str,
    resource: str,
    limit: int | None = None,
) -> Profile:
    """Ingest a fetched table, of ``limit`` rows when the caller asks for a limit."""
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be at least 1")
        fetched = fetched.limit(limit)
    return ingest(store, name, fetched, f"{source}:{resource}")
