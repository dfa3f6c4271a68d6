"""Trend times yearly seasonality, optionally with outside regressors.

Per entity: a linear trend over the month index, the ratio of each month to its
trend value, a seasonal index per calendar month from those ratios, and, with
regressors, the joint least squares of the ratio on month dummies and the
regressors. The dummies are eliminated by subtracting calendar-month means, so
only the regressors' within-month covariances are left to solve.

One shuffle on the entity serves the trend window and both aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.grids import expand_horizon
from tallycast.plans.least_squares import pairs, solve_moments

# Months are counted from January 2000; any origin gives the same fit.
_ORIGIN = 2000 * 12

# What every step carries along from the trend window.
_CARRIED = ["_slope", "_level", "_last", "n_obs"]


def _aggregate(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    carried = {c: f"first({c})" for c in _CARRIED}
    return df.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in {**columns, **carried}.items()])


def forecast_seasonal_trend(
    monthly: DataFrame,
    entity: str,
    value: str = "timelog",
    periods: int = 12,
    regressors: Sequence[str] = (),
    future_x: DataFrame | None = None,
    anchor: str = "last_obs",
    target_year: int | None = None,
) -> DataFrame:
    """``periods`` months per entity, by default after its own last observation.

    With ``target_year`` only rows of that year are returned, so an entity that
    stopped early has fewer. Entities with one observation are left out. No
    clamp is applied.

    ``regressors`` are columns of ``monthly``, any number of them. Their future
    values come from ``future_x`` (entity, year, month_num, regressors), or are
    the entity's historical means.
    """
    group = f"OVER (PARTITION BY `{entity}`)"
    # A month without its regressor takes no part in the season fit.
    complete = " AND ".join([f"`{x}` IS NOT NULL" for x in regressors] or ["true"])
    rows = (
        monthly.selectExpr(
            f"`{entity}`",
            "month_num",
            "CAST(year * 12 + month_num - 1 AS INT) AS _idx",
            f"CAST(year * 12 + month_num - 1 - {_ORIGIN} AS DOUBLE) AS _k",
            f"CAST(`{value}` AS DOUBLE) AS _y",
            *[f"CAST(`{x}` AS DOUBLE) AS _x_{i}" for i, x in enumerate(regressors)],
            f"{complete} AS _complete",
        )
        .selectExpr(
            "*",
            f"regr_slope(_y, _k) {group} AS _slope",
            f"regr_intercept(_y, _k) {group} AS _level",
            f"max(_idx) {group} AS _last",
            f"count(1) {group} AS n_obs",
        )
        .filter("n_obs >= 2")
        .withColumn("_r", F.expr("if(_complete, try_divide(_y, _level + _slope * _k), NULL)"))
    )
    seasons = _regressed(rows, entity, len(regressors)) if regressors else _averaged(rows, entity)
    future = expand_horizon(seasons, periods, anchor, target_year)
    if target_year is not None:
        future = future.filter(f"year = {target_year}")
    if future_x is not None and regressors:
        given = future_x.selectExpr(
            f"`{entity}`", "year", "month_num", *[f"CAST(`{x}` AS DOUBLE) AS _given_{i}" for i, x in enumerate(regressors)]
        )
        future = future.join(given, [entity, "year", "month_num"], "left")
        shifts = [f"coef_{i} * (coalesce(_given_{i}, _mean_{i}) - _mean_{i})" for i in range(len(regressors))]
    else:
        shifts = []  # at the historical mean a regressor adds nothing to its month's index
    season = " + ".join(["coalesce(try_element_at(_index, month_num), _index_mean, 1D)", *shifts])
    return future.selectExpr(
        f"`{entity}`",
        "ds",
        "year",
        "month_num",
        f"(_level + _slope * (_target - {_ORIGIN})) * ({season}) AS yhat",
        "n_obs",
        "if(_index_mean IS NULL, 'no_season', 'ok') AS fit_status",
    )


def _averaged(rows: DataFrame, entity: str) -> DataFrame:
    """Mean ratio per calendar month, normalised to average 1.

    An all-zero or trendless series has no ratios and keeps index 1.
    """
    per_month = _aggregate(rows, [entity, "month_num"], {"_m": "avg(_r)"})
    per_entity = _aggregate(
        per_month,
        [entity],
        {"_scale": "avg(_m)", "_cells": "collect_list(if(_m IS NOT NULL, struct(month_num, _m), NULL))"},
    )
    return per_entity.selectExpr(
        f"`{entity}`",
        *_CARRIED,
        "map_from_entries(transform(_cells, c -> struct(c.month_num, try_divide(c._m, _scale)))) AS _index",
        "if(_scale != 0, 1D, NULL) AS _index_mean",
    )


def _regressed(rows: DataFrame, entity: str, n: int) -> DataFrame:
    """Month index and regressor coefficients from one least-squares problem."""
    xs = [f"if(_r IS NOT NULL, _x_{i}, NULL)" for i in range(n)]
    per_month = _aggregate(
        rows,
        [entity, "month_num"],
        {
            "_m": "avg(_r)",
            "_n": "count(_r)",
            **{f"_xm_{i}": f"avg({x})" for i, x in enumerate(xs)},
            **{f"_sum_{i}": f"sum(_x_{i})" for i in range(n)},
            **{f"_count_{i}": f"count(_x_{i})" for i in range(n)},
            **{f"_s_{i}{j}": f"covar_pop({xs[i]}, {xs[j]})" for i, j in pairs(n)},
            **{f"_b_{i}": f"covar_pop({x}, _r)" for i, x in enumerate(xs)},
        },
    )
    means = ", ".join(f"_xm_{i}" for i in range(n))
    per_entity = _aggregate(
        per_month,
        [entity],
        {
            **{f"s_{i}{j}": f"sum(_n * _s_{i}{j})" for i, j in pairs(n)},
            **{f"b_{i}": f"sum(_n * _b_{i})" for i in range(n)},
            **{f"_mean_{i}": f"try_divide(sum(_sum_{i}), sum(_count_{i}))" for i in range(n)},
            "_cells": f"collect_list(if(_m IS NOT NULL, struct(month_num, _m, array({means}) AS _xm), NULL))",
        },
    )
    solved = solve_moments(per_entity, n)
    shifted = " ".join(f"- coef_{i} * (c._xm[{i}] - _mean_{i})" for i in range(n))
    indexed = solved.selectExpr("*", f"transform(_cells, c -> struct(c.month_num, c._m {shifted} AS s)) AS _season")
    return indexed.selectExpr(
        f"`{entity}`",
        *_CARRIED,
        *[f"coef_{i}" for i in range(n)],
        *[f"_mean_{i}" for i in range(n)],
        "map_from_entries(_season) AS _index",
        "try_divide(aggregate(_season, 0D, (acc, c) -> acc + c.s), size(_season)) AS _index_mean",
    )
