"""Integer apportionment and activity classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.operators.joins import null_safe_left_join, with_group_totals


def apportion(
    df: DataFrame, keys: Sequence[str], order: str, total: str | Column, weight: str, out: str = "share"
) -> DataFrame:
    """Split a group's integer total by weight so that the parts sum to it exactly.

    Each part is rounded half to even; what rounding leaves over goes to the
    group's first item by ``order``, which must be unique within the group.
    Groups whose weights sum to 0 put everything on the first item.

    Group sums travel as aggregates, not windows. The leftover joins back on
    (group, first item), so a hot group's rows stay spread out.
    """
    amount = F.col(total) if isinstance(total, str) else total
    sized = with_group_totals(
        df.withColumn("_amount", amount.cast("long")),
        keys,
        [F.sum(weight).cast("double").alias("_weights")],
        spread=[*keys, order],
    )
    exact = F.try_divide(F.col("_amount").cast("double") * F.col(weight), F.col("_weights"))
    parts = sized.withColumn("_part", F.coalesce(F.bround(exact), F.lit(0.0)).cast("long"))
    leftover = parts.groupBy(*keys).agg(
        F.min(order).alias(order), (F.max("_amount") - F.sum("_part")).alias("_leftover")
    )
    joined = null_safe_left_join(parts, leftover, [*keys, order])
    return joined.withColumn(out, F.col("_part") + F.coalesce("_leftover", F.lit(0))).drop(
        "_amount", "_weights", "_part", "_leftover"
    )


def activity_class(monthly: DataFrame, full: int = 160, value: str = "timelog") -> DataFrame:
    """Label gap-filled entity months: full_time, part_time or no_log."""
    hours = F.col(value)
    label = F.when(hours >= full, "full_time").when(hours > 0, "part_time").otherwise("no_log")
    return monthly.withColumn("activity", label)
