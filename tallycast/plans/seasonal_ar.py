"""Seasonal-difference autoregression on the gap-filled monthly grid.

``forecast_seasonal_ar`` is a window-and-aggregate plan: z_t = y_t - y_{t-12},
an AR(1) slope of z, and y_{T+h} = y_{T+h-12} + phi^h z_T.

``forecast_seasonal_arma`` adds moving-average terms at lags 1 and 12. Those have
no closed form, so the series of many entities are stacked per Arrow batch and
estimated together by two linear regressions (Hannan-Rissanen).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.grids import expand_horizon, fill_months

SEASON = 12
PHI_LIMIT = 0.99


def forecast_seasonal_ar(
    monthly: DataFrame, entity: str, first_year: int, last_year: int, value: str = "timelog", periods: int = 12
) -> DataFrame:
    """``periods`` months after ``last_year`` per entity, from the grid first_year..last_year.

    The slope is 0 where no month differs from the year before or the grid has
    fewer than 25 months; a grid below 12 months gives zeros. No clamp.
    """
    n_months = (last_year - first_year + 1) * 12
    last_idx = last_year * 12 + 11
    order = f"OVER (PARTITION BY `{entity}` ORDER BY month_idx)"
    grid = fill_months(monthly, entity, value, first_year, last_year)
    lagged = (
        grid.selectExpr("*", f"CAST(`{value}` AS DOUBLE) AS _y")
        .selectExpr("*", f"_y - lag(_y, {SEASON}) {order} AS _z")
        .selectExpr("*", f"lag(_z) {order} AS _z1")
    )
    per_entity = lagged.groupBy(entity).agg(
        F.expr("count_if(observed)").alias("n_obs"),
        F.expr("coalesce(try_divide(sum(_z * _z1), sum(_z1 * _z1)), 0D)").alias("_slope"),
        F.expr(f"coalesce(max(if(month_idx = {last_idx}, _z, NULL)), 0D)").alias("_last_z"),
        F.expr(
            f"array_sort(collect_list(if(month_idx > {last_idx - SEASON}, struct(month_idx, _y), NULL)))"
        ).alias("_recent"),
    )
    phi = "0D" if n_months < 25 else f"greatest(-{PHI_LIMIT}D, least({PHI_LIMIT}D, _slope))"
    future = expand_horizon(per_entity.selectExpr("*", f"{phi} AS _phi"), periods, "year", last_year + 1)
    # Beyond one year the differences of earlier forecasts add up: phi^h + phi^(h-12) + ...
    carried = f"""aggregate(sequence(0, (step - 1) DIV {SEASON}), 0D,
        (acc, j) -> acc + power(_phi, step - j * {SEASON}))"""
    status = "IF(n_obs >= 25, 'ok', 'short_history')"
    return future.selectExpr(
        f"`{entity}`",
        "ds",
        "year",
        "month_num",
        f"_recent[(step - 1) % {SEASON}]._y + {carried} * _last_z AS yhat",
        "n_obs",
        f"{status} AS fit_status",
    )


def _lag(x: np.ndarray, by: int, start: int) -> np.ndarray:
    """Columns ``start - by ..`` of x, aligned with x[:, start:]."""
    return x[:, start - by : x.shape[1] - by]


def _regress(columns: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Least squares for a stack of series: columns are (series, time)."""
    x = np.stack(columns, axis=2)
    gram = np.einsum("btp,btq->bpq", x, x)
    moment = np.einsum("btp,bt->bp", x, target)
    return np.einsum("bpq,bq->bp", np.linalg.pinv(gram, hermitian=True), moment)


def seasonal_arma_batch(y: np.ndarray, periods: int) -> np.ndarray:
    """Forecast a stack of equally long series (series, months)."""
    w = y[:, SEASON:] - y[:, :-SEASON]
    length = w.shape[1]
    order = max(1, min(13, (length - SEASON) // 3))
    long_ar = _regress([_lag(w, i, order) for i in range(1, order + 1)], w[:, order:])
    shock = np.zeros_like(w)
    shock[:, order:] = w[:, order:] - sum(
        long_ar[:, i - 1 : i] * _lag(w, i, order) for i in range(1, order + 1)
    )
    start = order + SEASON
    coefs = _regress([_lag(w, 1, start), _lag(shock, 1, start), _lag(shock, SEASON, start)], w[:, start:])
    phi, theta, seasonal = np.clip(coefs, -PHI_LIMIT, PHI_LIMIT).T
    # Shocks under the fitted model, then the expectation with future shocks at 0.
    total = length + periods
    path = np.concatenate([w, np.zeros((len(y), periods))], axis=1)
    a = np.zeros((len(y), total))

    def at(x: np.ndarray, t: int) -> np.ndarray | float:
        return x[:, t] if t >= 0 else 0.0

    for t in range(total):
        mean = (
            phi * at(path, t - 1)
            + theta * at(a, t - 1)
            + seasonal * at(a, t - SEASON)
            + theta * seasonal * at(a, t - SEASON - 1)
        )
        if t < length:
            a[:, t] = path[:, t] - mean
        else:
            path[:, t] = mean
    level = np.concatenate([y, np.zeros((len(y), periods))], axis=1)
    for h in range(periods):
        level[:, y.shape[1] + h] = level[:, y.shape[1] + h - SEASON] + path[:, length + h]
    return level[:, y.shape[1] :]


def forecast_seasonal_arma(
    monthly: DataFrame, entity: str, first_year: int, last_year: int, value: str = "timelog", periods: int = 12
) -> DataFrame:
    """As ``forecast_seasonal_ar`` with moving-average terms at lags 1 and 12.

    Needs a grid of 36 months; over a shorter one this is ``forecast_seasonal_ar``.
    An estimate that is not finite gives zeros. No clamp.
    """
    n_months = (last_year - first_year + 1) * 12
    if n_months < 36:
        return forecast_seasonal_ar(monthly, entity, first_year, last_year, value, periods)
    grid = fill_months(monthly, entity, value, first_year, last_year)
    series = grid.groupBy(entity).agg(
        F.count_if("observed").alias("n_obs"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("month_idx", F.col(value).cast("double").alias("y")))),
            lambda cell: cell["y"],
        ).alias("_series"),
    )

    @F.pandas_udf("array<double>")
    def forecast(batch: pd.Series) -> pd.Series:
        return pd.Series(list(seasonal_arma_batch(np.stack(batch.to_list()), periods)))

    scored = expand_horizon(
        series.withColumn("_path", forecast("_series")), periods, "year", last_year + 1
    ).withColumn("_raw", F.element_at("_path", F.col("step")))
    usable = F.col("_raw").isNotNull() & ~F.isnan("_raw") & (F.abs("_raw") != float("inf"))
    status = F.when(~usable, "failed").when(F.col("n_obs") < 36, "short_history").otherwise("ok")
    return scored.select(
        entity,
        "ds",
        "year",
        "month_num",
        F.when(usable, F.col("_raw")).otherwise(0.0).alias("yhat"),
        "n_obs",
        status.alias("fit_status"),
    )
