"""Result tables: one folder per model and run, or one table laid out by model and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def result_path(base: str, model: str, run: str, table: str) -> str:
    return f"{base.rstrip('/')}/model={model}/run={run}/{table}"


def write_result(
    df: DataFrame,
    base: str,
    model: str,
    run: str,
    table: str,
    fmt: str = "csv",
    single_file: bool = False,
) -> str:
    """Write a result and return its path.

    ``single_file`` funnels the write through one task, so it is meant for
    reports of a bounded size (winners, monthly totals), never for every
    entity's forecast.
    """
    path = result_path(base, model, run, table)
    out = df.repartition(1) if single_file else df  # what computes the rows keeps its own tasks
    out.write.mode("overwrite").option("header", True).format(fmt).save(path)
    return path


def read_result(
    spark: SparkSession,
    base: str,
    model: str,
    run: str,
    table: str,
    schema: T.StructType,
    fmt: str = "csv",
) -> DataFrame:
    """Read a written result for a later stage."""
    path = result_path(base, model, run, table)
    reader = spark.read.schema(schema).option("header", True)
    if fmt == "csv":
        reader = reader.option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def read_runs(spark: SparkSession, base: str, table: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """One table over all models and runs, with ``model`` and ``run`` columns from the folder names.

    As in ``read_result``, a bad cell or a header that differs from the schema fails the read.
    """
    keyed = T.StructType(
        [*schema.fields, T.StructField("model", T.StringType()), T.StructField("run", T.StringType())]
    )
    reader = spark.read.schema(keyed).option("header", True).option("basePath", base)
    if fmt == "csv":
        reader = reader.option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.format(fmt).load(result_path(base, "*", "*", table))


def write_run(df: DataFrame, table: str, model: str, run: str) -> None:
    """Put a result into a Parquet table laid out by model and run.

    What the table has of this model and run is replaced; other runs stay as they are. The rows
    are written by the tasks that compute them. A run without rows leaves an earlier one in
    place, so it is refused after the write, by the count taken during it.
    """
    from pyspark.sql import Observation

    seen = Observation()
    keyed = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumns({"model": F.lit(model), "run": F.lit(run)})
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model", "run").parquet(table)
    if not seen.get.get("n"):
        raise ValueError(f"no rows for model {model}, run {run}")


def read_run_table(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All models and runs of such a table; a filter on ``model`` or ``run`` reads their folders only."""
    keys = [T.StructField("model", T.StringType()), T.StructField("run", T.StringType())]
    return spark.read.schema(T.StructType([*schema.fields, *keys])).parquet(table)
