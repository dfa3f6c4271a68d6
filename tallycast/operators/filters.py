"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import month_name, month_start


def year_between(df: DataFrame, first: int, last: int, date: str | None = "date") -> DataFrame:
    """Rows of the years first..last, both included.

    Where a date column exists the same range is also put on it, because a
    range of a stored column reaches the scan and a computed year does not.
    """
    kept = df.filter(F.col("year").between(first, last)) if "year" in df.columns else df
    if date and date in df.columns:
        kept = kept.filter(
            (F.col(date) >= F.lit(f"{first}-01-01").cast("date"))
            & (F.col(date) < F.lit(f"{last + 1}-01-01").cast("date"))
        )
    return kept


def split_by_year(df: DataFrame, last_train_year: int) -> tuple[DataFrame, DataFrame]:
    """(rows up to the year, rows of the year after it)."""
    return (
        df.filter(F.col("year") <= last_train_year),
        df.filter(F.col("year") == last_train_year + 1),
    )


def one_entity(df: DataFrame, entity: str, name) -> DataFrame:
    return df.filter(F.col(entity) == F.lit(name))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def positive_only(df: DataFrame, value: str = "timelog") -> DataFrame:
    return df.filter(F.col(value) > 0)


def target_year_only(forecast: DataFrame, year: int) -> DataFrame:
    return forecast.filter(F.year("ds") == year)


def with_year(df: DataFrame, year: int) -> DataFrame:
    return df.withColumn("year", F.lit(year))


def as_series(
    monthly: DataFrame, entity: str, value: str = "timelog", regressors: Sequence[str] = ()
) -> DataFrame:
    """(entity, ds, y, regressors...): the time axis and target under fixed names.

    Rows without year or month are dropped.
    """
    kept = drop_null_keys(monthly, ["year", "month_num"])
    return kept.select(
        entity,
        month_start(F.col("year"), F.col("month_num")).alias("ds"),
        F.col(value).alias("y"),
        *regressors,
    )


def as_predictions(forecast: DataFrame, entity: str) -> DataFrame:
    """Forecast in the report spelling: (entity, month, predicted_hours, year)."""
    return forecast.select(
        entity,
        month_name(F.col("month_num")).alias("month"),
        F.col("yhat").alias("predicted_hours"),
        "year",
    )


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in a stated order."""
    return df.orderBy(*order).limit(n)
