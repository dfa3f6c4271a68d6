"""Chart-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import month_name
from tallycast.operators.rollups import year_span
from tallycast.storage import materialise


def series_with_forecast(
    history: DataFrame, forecast: DataFrame, target_year: int, value: str = "timelog", predicted: str = "yhat"
) -> DataFrame:
    """(month_num, month, series, value): one labelled line per year plus the prediction.

    Both inputs hold one row per (year, month), such as monthly totals or
    monthly winners.
    """
    past = history.select(
        "month_num", F.col("year").cast("string").alias("series"), F.col(value).cast("double").alias("value")
    )
    future = forecast.filter(F.col("year") == target_year).select(
        "month_num", F.lit(f"Predicted {target_year}").alias("series"), F.col(predicted).alias("value")
    )
    return past.unionByName(future).select(
        "month_num", month_name(F.col("month_num")).alias("month"), "series", "value"
    )


def year_month_matrix(monthly: DataFrame, years: Sequence[int] | None = None, value: str = "timelog") -> DataFrame:
    """One row per calendar month, one column per listed year.

    With a list no job runs to find the years. Without one they are all years from the table's first
    to its last; the table, one row per month at most, is kept and looked at once.
    """
    if years is None:
        monthly = materialise(monthly.select("year", "month_num", value), "month-values")
        years = year_span(monthly)
    if not years:
        return monthly.select("month_num").distinct()
    return monthly.groupBy("month_num").pivot("year", list(years)).agg(F.sum(value))


def period_label(year: Column, bounds: Sequence[tuple[int, int]]) -> Column:
    """'2010-2017' for a year inside one of the inclusive ranges, else null."""
    label = F.lit(None).cast("string")
    for first, last in reversed(bounds):
        label = F.when(year.between(first, last), F.lit(f"{first}-{last}")).otherwise(label)
    return label


def block_label(year: Column, first: int, last: int, width: int = 5) -> Column:
    """Equal blocks of years; the last one ends at ``last``."""
    bounds = [(start, min(start + width - 1, last)) for start in range(first, last + 1, width)]
    return period_label(year, bounds)
