"""URL verdicts: rules first, then a model of hashed character n-grams.

Method: host and path are cut out by expressions, the longest fitting rule
decides, and all other URLs are judged by a logistic regression on hashed
character n-grams of host and path. It is trained on a small labelled table:
by default at most ``TRAIN_ROWS`` distinct URLs whose verdict a rule gives, in
the order of a hash, so rules generalise to hosts and paths that resemble
theirs.

Defined cases: NULL URLs and URLs without ``://`` have empty host and path and
fit no rule; an empty labelled table gives ``allow`` to what no rule decides,
and a table of one verdict gives that verdict; repeated rows get equal
verdicts; URLs are read whole; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written

#: (rule, verdict) as host and path; fixed values of the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
TRAIN_ROWS = 4_000
BUCKETS = 1 << 13
GRAMS = (2, 3, 4)
SHRINK = 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; NULL if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decided in sorted(rules, key=lambda r: len(r[0])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, decided).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with its part and its ends."""

    def of(part: str, text: Column) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        found = [
            F.when(
                F.length(whole) >= n,
                F.transform(
                    F.sequence(F.lit(1), F.length(whole) - (n - 1)),
                    lambda i, n=n: F.concat(F.lit(part), F.substring(whole, i, F.lit(n))),
                ),
            ).otherwise(F.array().cast("array<string>"))
            for n in GRAMS
        ]
        return F.concat(*found)

    return F.concat(of("h", host), of("p", path))


def _hasher() -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="vector", numFeatures=BUCKETS, binary=True)


def train(labelled: DataFrame):
    """A model of ``labelled`` (host, path, verdict); a plain verdict where there is only one kind."""
    kinds = sorted(r["verdict"] for r in labelled.select("verdict").distinct().limit(3).collect())
    if len(kinds) < 2:
        return kinds[0] if kinds else "allow"
    rows = _hasher().transform(
        labelled.select(
            grams(F.col("host"), F.col("path")).alias("grams"),
            (F.col("verdict") == "block").cast("double").alias("label"),
        )
    )
    return LogisticRegression(featuresCol="vector", labelCol="label", regParam=SHRINK, maxIter=50).fit(rows)


def labelled_urls(parts: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` distinct (host, path, verdict) whose verdict a rule gives."""
    order = F.xxhash64("host", "path")
    return (
        parts.where("rule is not null")
        .select("host", "path", F.col("decided").alias("verdict"))
        .distinct()
        .orderBy(order, "host", "path")
        .limit(rows)
    )


def judge(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: tuple[tuple[str, str], ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages``."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), decided.alias("decided"))
    known = written(labelled_urls(parts) if labelled is None else labelled.select("host", "path", "verdict"))
    model = train(known)
    columns = ("page_id", "host", "path", "rule")
    if isinstance(model, str):
        return parts.select(*columns, F.coalesce("decided", F.lit(model)).alias("verdict"))
    model = model.setPredictionCol("blocked").setProbabilityCol("").setRawPredictionCol("")
    judged = model.transform(_hasher().transform(parts.withColumn("grams", grams(F.col("host"), F.col("path")))))
    learned = F.when(F.col("blocked") > 0.5, "block").otherwise("allow")
    return judged.select(*columns, F.coalesce("decided", learned).alias("verdict"))
