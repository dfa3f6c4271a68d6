"""Hook for a user's own per-series model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def forecast_grouped(
    monthly: DataFrame, entity: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType
) -> DataFrame:
    """Apply ``fn`` to each entity's months (in time order) and stack what it returns.

    Meant for monthly tables: a group is one series, so its size is bounded by
    the calendar. The built-in models need no Python per series and are far
    faster.
    """

    def ordered(series: pd.DataFrame) -> pd.DataFrame:
        return fn(series.sort_values(["year", "month_num"], ignore_index=True))

    # A stated partition count is kept by adaptive execution, which would otherwise merge
    # partitions by their few bytes and leave the Python work to one task. The grouping
    # reuses this partitioning.
    partitions = int(monthly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = monthly.repartition(partitions, entity)
    return spread.groupBy(entity).applyInPandas(ordered, schema)
