"""Sliding windows over an entity's months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_windows(df: DataFrame, entity: str, value: str, order: str = "month_idx", n: int = 12) -> DataFrame:
    """The n values before each row as ``lags`` (oldest first) and the row as ``target``.

    Only full windows are kept.
    """
    window = Window.partitionBy(entity).orderBy(order)
    return (
        df.withColumn("lags", F.collect_list(value).over(window.rowsBetween(-n, -1)))
        .filter(F.size("lags") == n)
        .withColumnRenamed(value, "target")
    )


def last_context(df: DataFrame, entity: str, value: str, order: str = "month_idx", n: int = 12) -> DataFrame:
    """The last n values of each entity as ``context``, oldest first; shorter series drop out."""
    window = Window.partitionBy(entity).orderBy(order)
    return (
        df.withColumns(
            {
                "context": F.collect_list(value).over(window.rowsBetween(-(n - 1), 0)),
                "_next": F.lead(order).over(window),
            }
        )
        .filter(F.col("_next").isNull() & (F.size("context") == n))
        .select(entity, order, "context")
    )
