"""Time logs and the project dimension, as headered CSV or as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.functions.calendar import month_name, normalise_month
from tallycast.schemas import LOG_LAYOUTS, PROJECTS


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    if fmt == "csv":
        # Header names are checked against the schema, and a bad cell fails the read.
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .csv(path)
        )
    return spark.read.schema(schema).format(fmt).load(path)


def parse_date(df: DataFrame, col: str = "date") -> DataFrame:
    """Text 'YYYY-MM-DD' to a date. Text that is no date fails the query."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(col, F.to_date(F.col(col), "yyyy-MM-dd"))
    return df.withColumn(col, F.col(col).cast("date"))


def read_timelogs(
    spark: SparkSession, path: str, fmt: str = "csv", layout: str = "numeric_month"
) -> DataFrame:
    """Logs in canonical form: ``date`` as a date and ``month_num`` as an integer.

    Where the files are laid out in folders by year, a filter on ``year`` reads those folders only.
    """
    raw = _read(spark, path, fmt, LOG_LAYOUTS[layout])
    return normalise_month(parse_date(raw)).drop("month", "userid")


def write_timelogs(
    logs: DataFrame, path: str, fmt: str = "csv", layout: str = "numeric_month", by_year: bool = False
) -> None:
    """Canonical logs back to a file layout that ``read_timelogs`` accepts, in a folder for each year if asked."""
    named = logs.withColumn(
        "month", month_name(F.col("month_num")) if layout == "text_month" else F.col("month_num")
    ).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    if "userid" not in named.columns:
        named = named.withColumn("userid", F.lit(None).cast("long"))
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_LAYOUTS[layout]]
    writer = named.select(*columns).write.mode("overwrite").option("header", True).format(fmt)
    (writer.partitionBy("year") if by_year else writer).save(path)


def read_projects(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, fmt, PROJECTS)


def write_projects(projects: DataFrame, path: str, fmt: str = "csv") -> None:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PROJECTS]
    projects.select(*columns).write.mode("overwrite").option("header", True).format(fmt).save(path)
