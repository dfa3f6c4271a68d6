"""Data checks: reports as DataFrames, and guards that fail the query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import MONTHS
from tallycast.storage import materialise


def null_audit(df: DataFrame) -> DataFrame:
    """(column, null_count): one pass over the data, one row per column."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], list(df.columns), "column", "null_count")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails when the plan is built, before any data is read."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Passes rows through; a null in one of the columns fails the query."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in column {c}")).cast(df.schema[c].dataType))
            for c in columns
        }
    )


def calendar_violations(df: DataFrame, month: str = "month", truncate: bool = False) -> DataFrame:
    """Rows without a year or with an unusable month name, with the reason."""
    name = F.substring(month, 1, 3) if truncate else F.col(month)
    bad_year = F.coalesce(~F.col("year").between(1, 9999), F.lit(True))
    reason = (
        F.when(F.col(month).isNull(), "month missing")
        .when(~name.isin(*MONTHS), "month unknown")
        .when(bad_year, "date invalid")
    )
    # The filter repeats the plain tests; filtering on the reason would copy its whole expression.
    violating = F.col(month).isNull() | ~name.isin(*MONTHS) | bad_year
    return df.filter(violating).withColumn("reason", reason)


def peak_month(monthly: DataFrame, value: str = "timelog") -> DataFrame:
    """The largest value of any entity and month."""
    return monthly.agg(F.max(value).alias(f"max_{value}"))


def limit_violations(monthly: DataFrame, limit: int = 160, value: str = "timelog") -> DataFrame:
    """Entity months above the limit."""
    return monthly.filter(F.col(value) > limit)


def require_rows(df: DataFrame, what: str = "forecast", kept: bool = False) -> DataFrame:
    """The table, kept; fails when it has no row at all.

    The plan runs once: its result is written to the shared folder, and looked at there.
    ``kept`` says that ``df`` is read from a written table already.
    """
    table = df if kept else materialise(df, "required")
    if table.isEmpty():
        raise ValueError(f"no rows: {what}")
    return table
