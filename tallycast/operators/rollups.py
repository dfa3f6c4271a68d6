"""Aggregations. Each is a partial/final hash aggregate with one shuffle on its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import MONTHS, month_name_of


def _with_keys(logs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all present; plain IS NOT NULL tests reach the scan and both join sides."""
    return logs.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))


def monthly_rollup(
    logs: DataFrame, entity: str, value: str = "timelog", means: Sequence[str] = ()
) -> DataFrame:
    """Hours per entity and month, plus row means of further columns.

    One aggregation yields all measures. Rows without an entity, year or month
    are left out; a month whose values are all missing counts as 0.
    """
    keys = [entity, "year", "month_num"]
    return (
        _with_keys(logs, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(value), F.lit(0)).alias(value),
            *[F.avg(c).alias(c) for c in means],
        )
    )


def totals(logs: DataFrame, keys: Sequence[str], value: str = "timelog", count: str | None = None) -> DataFrame:
    """Sum of the value per key combination; ``count`` adds the number of log rows under that name
    (summed, where the rows are themselves totals with such a column)."""
    measures = [F.coalesce(F.sum(value), F.lit(0)).alias(value)]
    if count:
        measures.append((F.sum(count) if count in logs.columns else F.count(F.lit(1))).alias(count))
    return (_with_keys(logs, keys) if keys else logs).groupBy(*keys).agg(*measures)


def log_cells(logs: DataFrame) -> DataFrame:
    """Sum and row count per user, project and month.

    The finest table the reports need: every other rollup is a sum over it, so
    one scan of the log is enough for all of them. Rows without user or without
    project stay; each rollup leaves out those that lack its own key.
    """
    keys = ["username", "projectid", "projectname", "year", "month_num"]
    return (
        _with_keys(logs, ["year", "month_num"])
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("timelog"), F.lit(0)).alias("timelog"), F.count(F.lit(1)).alias("n_rows"))
    )


def user_months_with_project(cells: DataFrame) -> DataFrame:
    """Monthly hours per user with the row mean of the project id, from ``log_cells``."""
    weighted = F.when(F.col("projectid").isNotNull(), F.col("n_rows"))
    return _with_keys(cells, ["username", "year", "month_num"]).groupBy("username", "year", "month_num").agg(
        F.sum("timelog").alias("timelog"),
        F.try_divide(F.sum(F.col("projectid") * weighted), F.sum(weighted)).alias("projectid"),
    )


def user_months_with_activity(cells: DataFrame) -> DataFrame:
    """``user_months_with_project`` and, per user and month, the number of log rows (n_rows), of projects
    (n_projects) and the hours of the largest project (top_hours), in the same aggregation."""
    weighted = F.when(F.col("projectid").isNotNull(), F.col("n_rows"))
    return _with_keys(cells, ["username", "year", "month_num"]).groupBy("username", "year", "month_num").agg(
        F.sum("timelog").alias("timelog"),
        F.try_divide(F.sum(F.col("projectid") * weighted), F.sum(weighted)).alias("projectid"),
        F.sum("n_rows").alias("n_rows"),
        F.count("projectid").alias("n_projects"),
        F.max("timelog").alias("top_hours"),
    )


def monthly_total(monthly: DataFrame, value: str = "timelog", expand_months: bool = False) -> DataFrame:
    """Sum over all entities per month.

    ``expand_months`` yields all twelve months of every year present, absent
    ones as 0. The expansion works on the totals, at most twelve per year.
    """
    summed = monthly.groupBy("year", "month_num").agg(F.sum(value).alias(value))
    if not expand_months:
        return summed
    per_year = summed.groupBy("year").agg(
        F.map_from_entries(F.collect_list(F.struct("month_num", value))).alias("_cells")
    )
    months = per_year.select(
        "year", "_cells", F.explode(F.sequence(F.lit(1), F.lit(len(MONTHS)))).alias("month_num")
    )
    return months.select(
        "year",
        "month_num",
        F.coalesce(F.try_element_at("_cells", F.col("month_num")), F.lit(0)).alias(value),
    )


def mean_per_entity(monthly: DataFrame, entity: str, value: str = "timelog") -> DataFrame:
    """Mean of an entity's monthly sums."""
    return monthly.groupBy(entity).agg(F.avg(value).alias(f"mean_{value}"))


def population_mean(monthly: DataFrame, entity: str, value: str = "timelog") -> DataFrame:
    """Mean monthly total divided by the number of entities: one row.

    Month sums and entities are two grouping sets of one pass; both shrink in
    the partial aggregation, before the shuffle.
    """
    grouped = monthly.groupingSets(
        [[F.col("year"), F.col("month_num")], [F.col(entity)]], "year", "month_num", entity
    ).agg(F.sum(value).cast("double").alias("_sum"), F.grouping(entity).alias("_is_month"))
    total = grouped.agg(
        F.sum(F.when(F.col("_is_month") == 1, F.col("_sum"))).alias("_sum"),
        F.count_if(F.col("_is_month") == 1).alias("_months"),
        F.count_if((F.col("_is_month") == 0) & F.col(entity).isNotNull()).alias("_entities"),
    )
    return total.select(
        F.try_divide(F.try_divide("_sum", "_months"), F.col("_entities")).alias("population_mean")
    )


def year_span(monthly: DataFrame, year: str = "year") -> range:
    """All years from the first to the last one of a table; none for an empty one.

    Runs one small aggregate, so hand in a kept table rather than a log.
    """
    first, last = monthly.agg(F.min(year), F.max(year)).first()
    return range(first, last + 1) if first is not None else range(0)


def rows_per_entity(monthly: DataFrame, entity: str) -> DataFrame:
    return monthly.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_entities(logs: DataFrame, entity: str) -> DataFrame:
    return logs.select(entity).distinct()


def count_entities(logs: DataFrame, entity: str, approximate: bool = False) -> DataFrame:
    counted = F.approx_count_distinct(entity) if approximate else F.count_distinct(entity)
    return logs.agg(counted.alias("n_entities"))


def months_present(logs: DataFrame, date: str = "date") -> DataFrame:
    """Distinct month names occurring in the log."""
    return logs.select(month_name_of(F.col(date)).alias("month")).distinct()
