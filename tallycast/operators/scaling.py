"""Per-entity scaling. A series holds one row per month, so its window stays small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaling_stats(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per entity; a zero deviation reads 1."""
    aggregates = []
    for c in columns:
        deviation = F.stddev_pop(c)
        aggregates.append(F.avg(c).alias(f"{c}_mean"))
        aggregates.append(F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"{c}_std"))
    return df.groupBy(entity).agg(*aggregates)


def standardise(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Add ``<col>_z`` = (value - mean) / deviation within the entity."""
    group = Window.partitionBy(entity)
    scaled = {}
    for c in columns:
        deviation = F.stddev_pop(c).over(group)
        scaled[f"{c}_z"] = (F.col(c) - F.avg(c).over(group)) / F.when(deviation == 0, 1.0).otherwise(
            deviation
        )
    return df.withColumns(scaled)


def minmax_scale(df: DataFrame, entity: str, value: str = "timelog") -> DataFrame:
    """Add ``scaled`` in [0, 1] with the ``low`` and ``span`` that undo it.

    A constant series has span 1, so it scales to 0.
    """
    group = Window.partitionBy(entity)
    low = F.min(value).over(group).cast("double")
    spread = (F.max(value).over(group) - F.min(value).over(group)).cast("double")
    ranged = df.withColumns({"low": low, "span": F.when(spread == 0, 1.0).otherwise(spread)})
    return ranged.withColumn("scaled", (F.col(value) - F.col("low")) / F.col("span"))


def inverse_minmax(scaled: Column, low: Column, span: Column) -> Column:
    return scaled * span + low
