"""Shared-folder storage: lineage cuts and scratch paths that outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local master (one machine, as in tests) uses a
    folder in the warehouse; a cluster must name a folder its machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch path whose readers are done."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


# Deletes a query's shuffle files when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_scratch(df: DataFrame, label: str) -> str:
    """Write as Parquet to a fresh path of the shared folder; nothing of the query but this is left on disk."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


def materialise(df: DataFrame, label: str = "kept") -> DataFrame:
    """Compute once, keep as Parquet in the shared folder, and cut the lineage there.

    For a table that several jobs read (a monthly rollup behind a fit and its
    scoring), so the raw log is scanned once. Readers of the kept table still get
    column pruning and pushed filters, and lost executors cost no recomputation.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, label))
