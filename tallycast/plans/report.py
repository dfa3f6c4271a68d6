"""One analysis run: history, forecasts, winners and chart tables, written per model.

The log is scanned once into (user, project, month) cells; every table below is
a rollup of those cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import month_name
from tallycast.operators import charts, filters, quality, ranking, rollups
from tallycast.operators.quality import require_rows
from tallycast.plans import evaluate, pooled, seasonal_ar, seasonal_trend
from tallycast.plans.least_squares import KINDS, forecast_ols
from tallycast.sources.results import read_result, write_result
from tallycast.storage import materialise

# (monthly, entity, first_year, target_year) -> forecast
Forecaster = Callable[[DataFrame, str, int, int], DataFrame]
REGRESSOR_MODEL = "seasonal_trend_regressor"


def _ols(kind: str) -> Forecaster:
    return lambda monthly, entity, first, target: forecast_ols(monthly, entity, target, features=kind)


def _seasonal_trend(monthly: DataFrame, entity: str, first: int, target: int) -> DataFrame:
    return seasonal_trend.forecast_seasonal_trend(monthly, entity, target_year=target)


def with_regressors(regressors: Sequence[str] = ("projectid",), future_x: DataFrame | None = None) -> Forecaster:
    """Seasonal trend with those of the regressors that a monthly table has; by default the project mean of users.

    ``future_x`` (entity, year, month_num, regressors) gives future values to the entities it names.
    """

    def forecast(monthly: DataFrame, entity: str, first: int, target: int) -> DataFrame:
        own = [x for x in regressors if x in monthly.columns]
        ahead = future_x if future_x is not None and own and {entity, *own} <= set(future_x.columns) else None
        return seasonal_trend.forecast_seasonal_trend(
            monthly, entity, regressors=own, future_x=ahead, target_year=target
        )

    return forecast


MODELS: dict[str, Forecaster] = {
    **{kind: _ols(kind) for kind in KINDS},
    "seasonal_ar": lambda m, e, first, target: seasonal_ar.forecast_seasonal_ar(m, e, first, target - 1),
    "seasonal_arma": lambda m, e, first, target: seasonal_ar.forecast_seasonal_arma(m, e, first, target - 1),
    "seasonal_trend": _seasonal_trend,
    REGRESSOR_MODEL: with_regressors(),
    "pooled_ar": lambda m, e, first, target: pooled.forecast_pooled_ar(m, e, target, first_year=first),
    "pooled_hinges": lambda m, e, first, target: pooled.forecast_pooled_hinges(m, e, target),
    "pooled_gbt": lambda m, e, first, target: pooled.forecast_pooled_gbt(m, e, target),
}


def _checks(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nulls per column, and counts of rows without a usable month or year, by reason.

    A month number outside 1..12 fails the run here, before anything is predicted from it."""
    months = logs.withColumn("month", month_name(F.col("month_num")))
    unusable = quality.calendar_violations(months).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
    return quality.null_audit(logs), unusable


def _holdout(tested: DataFrame, entity: str) -> DataFrame:
    """The tested year by month: totals, and the entity that was and was predicted to be first."""
    keys = ["year", "month_num"]
    totals = tested.groupBy(*keys).agg(F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"))
    out = totals
    for side in ("predicted", "actual"):
        first = ranking.top_predicted(tested, entity, side)
        out = out.join(first.select(*keys, F.col(entity).alias(f"first_{side}")), keys, "left")
    return out.orderBy(*keys)


def run_report(
    logs: DataFrame,
    base: str,
    run: str,
    model: str,
    first_year: int,
    last_year: int,
    backtest: bool = False,
    fmt: str = "csv",
    limit: int = 160,
    regressors: Sequence[str] = ("projectid",),
    monthly_x: DataFrame | None = None,
    future_x: DataFrame | None = None,
) -> dict[str, str]:
    """Analyse the years first_year..last_year and predict the year after.

    Returns table name -> path. Every run also writes its checks (nulls per column,
    rows whose month or year is unusable, user months above ``limit`` hours), the year by
    month matrices, and totals per block of years. With ``backtest`` the last year is also
    predicted from the years before it and set beside what happened, per entity and
    for the month's winners and totals.

    The model with regressors takes them from the users' monthly table (``projectid``) and from
    ``monthly_x`` (username, year, month_num, further columns); ``future_x`` has the values of the
    predicted months, which are else the user's historical means. A user's month that ``monthly_x``
    lacks takes no part in the season fit.
    """
    target = last_year + 1
    forecaster = with_regressors(regressors, future_x) if model == REGRESSOR_MODEL else MODELS[model]
    years = list(range(first_year, last_year + 1))
    cells = materialise(rollups.log_cells(filters.year_between(logs, first_year, last_year)))
    users = rollups.user_months_with_project(cells)
    known = users if monthly_x is None else materialise(users.join(monthly_x, ["username", "year", "month_num"], "left"))
    projects = rollups.monthly_rollup(cells, "projectname")
    paths: dict[str, str] = {}

    def save(table: str, df: DataFrame, small: bool = False) -> None:
        paths[table] = write_result(df, base, model, run, table, fmt, single_file=small)

    def named(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumn("month", month_name(F.col("month_num"))).select(*columns)

    audit, unusable = _checks(logs)
    save("null_audit", audit, small=True)
    save("month_violations", unusable, small=True)
    save("limit_violations", named(quality.limit_violations(users, limit), "username", "year", "month", "timelog"))

    top_users = ranking.top_user_per_month(users)
    save(
        "historical_top_users",
        named(ranking.in_calendar_order(top_users), "year", "month", "username", "timelog", "projectid"),
        small=True,
    )
    save(
        "top_user_per_project",
        ranking.top_user_per_project(rollups.totals(cells, ["projectname", "username"])),
    )
    save("historical_projects", named(projects, "year", "month", "projectname", "timelog"))
    totals = rollups.monthly_total(projects, expand_months=True)
    save("historical_month_totals", named(totals, "year", "month", "timelog"), small=True)
    for table, monthly in (("matrix_top_users", top_users), ("matrix_month_totals", totals)):
        matrix = named(charts.year_month_matrix(monthly, years), "month_num", "month", *[f"`{y}`" for y in years])
        save(table, matrix.orderBy("month_num").drop("month_num"), small=True)
    blocks = totals.withColumn("block", charts.block_label(F.col("year"), first_year, last_year))
    by_block = rollups.totals(blocks, ["block", "month_num"])
    save("block_month_totals", named(by_block, "block", "month", "timelog"), small=True)

    for kind, entity, monthly in [("users", "username", known), ("projects", "projectname", projects)]:
        # All predictions are kept; winners and totals are read off the kept table.
        table = f"all_{kind}_predictions"
        forecast = forecaster(monthly, entity, first_year, target)
        save(table, forecast)
        kept = require_rows(read_result(logs.sparkSession, base, model, run, table, forecast.schema, fmt), kept=True)
        winners = ranking.top_predicted(kept, entity)
        save(
            f"top_{kind}_predictions",
            filters.as_predictions(ranking.in_calendar_order(winners), entity),
            small=True,
        )
        predicted_totals = rollups.totals(kept, ["year", "month_num"], "yhat")
        history = top_users if kind == "users" else totals
        ahead = winners if kind == "users" else predicted_totals
        save(f"chart_{kind}", charts.series_with_forecast(history, ahead, target), small=True)
        if backtest:
            tested = materialise(
                evaluate.backtest(
                    monthly, entity, last_year, lambda train: forecaster(train, entity, first_year, last_year)
                )
            )
            save(f"backtest_{kind}", tested)
            save(f"accuracy_{kind}", evaluate.accuracy(tested, [entity]))
            save(f"holdout_{kind}", _holdout(tested, entity), small=True)
    return paths
