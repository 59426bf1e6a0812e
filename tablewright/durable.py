"""Results that are read more than once, kept where every executor sees them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# One process runs the driver and all tasks: "local", "local[4]", "local[*,2]".
_ONE_PROCESS = re.compile(r"local(\[[^\]]*\])?")
_local_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary folder only where one process runs everything."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not _ONE_PROCESS.fullmatch(spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tablewright-")
    return _local_folders[app]


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to ``folder``, or else the shared folder, and read back.

    Cuts lineage like ``checkpoint()`` does and survives lost executors, but
    stays columnar, so later passes prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_written(spark: SparkSession) -> int:
    """Delete what :func:`written` has left in this application; returns the number of tables.

    Results that still read them fail afterwards, so call it when they are stored.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
