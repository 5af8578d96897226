"""Intermediate tables in the folder that the driver and all executors share.

A multi-step operator cuts its lineage by writing a Parquet table and reading
it back. The folder is the cluster's ``spark.checkpoint.dir``; only where that
is unset (tests, a laptop) does the session get one of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Spark then deletes a query's shuffle files on all executors as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named, a folder made for this application if it runs on one machine, else an error."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _own.setdefault(app, None) or tempfile.mkdtemp(prefix="papyra-")
        _own[app] = named
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table; no two calls give the same."""
    return f"{shared_dir(spark)}/papyra-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    What is computed after it survives the loss of any executor, as no block
    of it lives on one machine only.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more; others, and what is derived from settled ones, stay."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Drop all intermediate tables of this application (call when their readers are done)."""
    _delete(spark, f"{shared_dir(spark)}/papyra-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
