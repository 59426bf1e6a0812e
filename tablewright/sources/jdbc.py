"""MySQL and PostgreSQL tables through Spark's JDBC source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.coerce import require_rows

# Fixed value: names allowed inside SQL text.
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

# Driver, default port and quote of each database.
_DATABASES = {
    "mysql": ("com.mysql.cj.jdbc.Driver", 3306, "`"),
    "postgresql": ("org.postgresql.Driver", 5432, '"'),
}


def validate_identifier(name: str, kind: str = "identifier") -> str:
    """The name itself, or ValueError unless it is letters, digits and underscores."""
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise ValueError(
            f"{kind} {name!r} must be letters, digits and underscores, not starting with a digit"
        )
    return name


@dataclass(frozen=True)
class Partitioning:
    """Splits a table into ``partitions`` ranges of a numeric or date column."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": validate_identifier(self.column, "partition column"),
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


@dataclass(frozen=True)
class JdbcSource:
    """One database. ``schema`` applies to PostgreSQL only."""

    kind: str
    host: str
    database: str
    user: str
    password: str = field(default="", repr=False)
    port: int | None = None
    schema: str = "public"

    def __post_init__(self):
        if self.kind not in _DATABASES:
            raise ValueError(f"Unknown database '{self.kind}'")
        for name in ("host", "database", "user"):
            if not getattr(self, name):
                raise ValueError(f"'{name}' is required")
        validate_identifier(self.schema, "schema name")

    def options(self) -> dict[str, str]:
        driver, port, _ = _DATABASES[self.kind]
        return {
            "url": f"jdbc:{self.kind}://{self.host}:{self.port or port}/{self.database}",
            "driver": driver,
            "user": self.user,
            "password": self.password,
            "fetchsize": "10000",
        }

    def table(self, name: str) -> str:
        quote = _DATABASES[self.kind][2]
        quoted = quote + validate_identifier(name, "table name") + quote
        if self.kind == "postgresql":
            return f"{quote}{self.schema}{quote}.{quoted}"
        return quoted

    def read(
        self,
        spark: SparkSession,
        table: str,
        limit: int | None = None,
        partitioning: Partitioning | None = None,
    ) -> DataFrame:
        """A table. Filters, columns and ``limit`` are pushed to the database.

        Give ``partitioning`` for large tables, or one task reads everything.
        """
        options = {**self.options(), "dbtable": self.table(table)}
        if partitioning:
            options |= partitioning.options()
        df = spark.read.format("jdbc").options(**options).load()
        if limit is not None:
            df = df.limit(limit)
        require_rows(df, f"table '{table}' has no rows")
        return df

    def list_tables(self, spark: SparkSession) -> DataFrame:
        """Names of the tables that can be imported."""
        catalog = (
            spark.read.format("jdbc")
            .options(**self.options(), dbtable="information_schema.tables")
            .load()
        )
        return tables_in_schema(
            catalog, self.schema if self.kind == "postgresql" else self.database
        )


def tables_in_schema(catalog: DataFrame, schema: str) -> DataFrame:
    """table_name rows of one schema out of an information_schema.tables relation."""
    names = catalog.toDF(*[c.lower() for c in catalog.columns])
    return (
        names.where(F.col("table_schema") == schema).select("table_name").orderBy("table_name")
    )
