"""Winners and top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_k(
    df: DataFrame,
    partition: Sequence[str],
    value: str,
    tiebreak: Sequence[str],
    k: int = 1,
    smallest: bool = False,
    salts: int | None = None,
) -> DataFrame:
    """The k largest rows per group; equal values go to the smallest tiebreak, as text.

    Null and NaN values never rank, so a group without any other value has no row.

    A ``row_number() <= k`` filter is pruned before the shuffle: each task sends
    at most k rows per group. The planner only does so up to its own limit on
    k; beyond that a first round over salted subgroups keeps any one task from
    receiving a whole group, with the same result.
    """
    by_value = F.col(value).asc() if smallest else F.col(value).desc()
    order = [by_value, *[F.col(t).cast("string").asc() for t in tiebreak]]
    df = df.filter(F.col(value).isNotNull())
    if isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        df = df.filter(~F.isnan(value))
    prune_limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))

    def keep(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
        return ranked.filter(F.col("_rank") <= k).drop("_rank")

    if k <= prune_limit:
        return keep(df, partition)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts or prune_limit)))
    return keep(keep(salted, [*partition, "_salt"]).drop("_salt"), partition)


def top_user_per_month(monthly: DataFrame, entity: str = "username", value: str = "timelog") -> DataFrame:
    return top_k(monthly, ["year", "month_num"], value, [entity])


def top_user_per_project(
    project_user_totals: DataFrame,
    project: str = "projectname",
    user: str = "username",
    value: str = "timelog",
) -> DataFrame:
    return top_k(project_user_totals, [project], value, [user])


def top_predicted(forecast: DataFrame, entity: str, value: str = "yhat") -> DataFrame:
    """Entity with the highest prediction per future month."""
    return top_k(forecast, ["year", "month_num"], value, [entity])


def in_calendar_order(df: DataFrame, *tail: str) -> DataFrame:
    """Sort by year and month number; ``tail`` columns settle the rest.

    On a table with many rows per month the tail is also what keeps the range
    partitions of the sort even.
    """
    return df.orderBy("year", "month_num", *tail)
