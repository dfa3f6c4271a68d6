from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.plans.pooled import forecast_pooled_ar, forecast_pooled_gbt, lag_frame
from tests.conftest import rows
from tests.test_seasonal import seasonal_series


def grid_of(points, first, last):
    have = {(y, m): v for y, m, v in points}
    return np.array([have.get((y, m), 0) for y in range(first, last + 1) for m in range(1, 13)], float)


def brute_pooled_ar(series, first, last, lags=12, periods=12):
    scaled, undo = {}, {}
    for name, points in series.items():
        y = grid_of(points, first, last)
        span = y.max() - y.min() or 1.0
        scaled[name], undo[name] = (y - y.min()) / span, (y.min(), span)
    x = [s[t - lags : t] for s in scaled.values() for t in range(lags, len(s))]
    target = [s[t] for s in scaled.values() for t in range(lags, len(s))]
    coef = np.linalg.lstsq(np.column_stack([np.array(x), np.ones(len(x))]), np.array(target), rcond=None)[0]
    out = {}
    for name, s in scaled.items():
        path = list(s)
        for _ in range(periods):
            path.append(float(np.dot(coef[:-1], path[-lags:]) + coef[-1]))
        low, span = undo[name]
        out[name] = np.array(path[-periods:]) * span + low
    return out


def test_pooled_ar_against_numpy(monthly):
    series = seasonal_series(years=range(2016, 2022))
    got = {}
    forecast = forecast_pooled_ar(monthly(series), "entity", 2022, first_year=2016)
    for r in forecast.orderBy("ds").collect():
        got.setdefault(r.entity, []).append(r.yhat)
    expected = brute_pooled_ar(series, 2016, 2021)
    assert set(got) == set(expected)
    for name in expected:
        assert np.allclose(got[name], expected[name], rtol=1e-6, atol=1e-6), name


def test_pooled_ar_drops_series_without_a_full_window(monthly):
    series = seasonal_series(gaps=0)
    series["twelve"] = [(2021, m, m) for m in range(1, 13)]
    series["thirteen"] = [(2020, 12, 5)] + [(2021, m, m) for m in range(1, 13)]
    frame = lag_frame(monthly(series), "entity", fill_gaps=False)
    names = {r.entity for r in frame.select("entity").distinct().collect()}
    assert "twelve" not in names and "thirteen" in names
    assert rows(frame.filter("entity = 'thirteen'").groupBy().agg(F.count("target"), F.count(F.lit(1)))) == [(1, 2)]


def test_constant_series_stay_constant(monthly):
    series = seasonal_series(gaps=0)
    series["flat"] = [(y, m, 100) for y in range(2018, 2022) for m in range(1, 13)]
    forecast = forecast_pooled_ar(monthly(series), "entity", 2022, first_year=2018).filter("entity = 'flat'")
    assert forecast.count() == 12 and forecast.filter("isnan(yhat)").count() == 0


def _error(forecast, actual):
    truth = {(e, y, m): v for e, points in actual.items() for y, m, v in points}
    return np.sqrt(np.mean([(r.yhat - truth[(r.entity, r.year, r.month_num)]) ** 2 for r in forecast.collect()]))


def test_pooled_models_beat_last_years_values(monthly):
    """On noisy seasonal series both pooled learners do better than repeating last year."""
    rng = np.random.default_rng(11)
    series = {}
    for i in range(40):
        level = rng.uniform(80, 200)
        series[f"e{i}"] = [
            (y, m, int(level * (1 + 0.2 * np.sin(2 * np.pi * m / 12)) + rng.normal(0, 15)))
            for y in range(2015, 2022)
            for m in range(1, 13)
        ]
    train = {e: [p for p in points if p[0] < 2021] for e, points in series.items()}
    test = {e: [p for p in points if p[0] == 2021] for e, points in series.items()}
    last = {(e, m): v for e, points in series.items() for y, m, v in points if y == 2020}
    naive = np.sqrt(np.mean([(v - last[(e, m)]) ** 2 for e, points in test.items() for _, m, v in points]))
    df = monthly(train)
    assert _error(forecast_pooled_ar(df, "entity", 2021, first_year=2015), test) < naive
    first = forecast_pooled_gbt(df, "entity", 2021)
    assert _error(first, test) < naive
    again = forecast_pooled_gbt(df, "entity", 2021)
    both = first.join(again.select("entity", "ds", F.col("yhat").alias("other")), ["entity", "ds"])
    assert both.count() == 480
    assert both.agg(F.max(F.abs(F.col("yhat") - F.col("other")))).first()[0] == pytest.approx(0, abs=1e-9)


def test_pooled_trees_guard_short_series(monthly):
    series = seasonal_series()
    series["two"] = [(2021, 1, 5), (2021, 2, 6)]
    got = forecast_pooled_gbt(monthly(series), "entity", 2022, max_iter=3)
    two = got.filter("entity = 'two'").groupBy("fit_status").agg(F.sum("yhat"), F.count("ds"))
    assert rows(two) == [("short_history", 0.0, 12)]
    assert got.filter("yhat < 0 OR isnan(yhat)").count() == 0 and got.count() == 7 * 12


def test_status_counts_the_months_that_were_seen(monthly):
    from tallycast.plans.pooled import forecast_pooled_ar
    from tallycast.plans.seasonal_ar import forecast_seasonal_ar, forecast_seasonal_arma

    series = {
        "full": [(y, m, 10 + m + y % 3) for y in range(2018, 2022) for m in range(1, 13)],
        "once": [(2019, 5, 7)],
    }
    table = monthly(series)
    for forecast in (
        forecast_pooled_ar(table, "entity", 2022, first_year=2018),
        forecast_seasonal_ar(table, "entity", 2018, 2021),
        forecast_seasonal_arma(table, "entity", 2018, 2021),
    ):
        status = {r.entity: r.fit_status for r in forecast.select("entity", "fit_status").distinct().collect()}
        assert status == {"full": "ok", "once": "short_history"}


def test_short_grids_of_the_moving_average_model_fall_back(monthly):
    from tallycast.plans.seasonal_ar import forecast_seasonal_ar, forecast_seasonal_arma

    table = monthly({"a": [(y, m, 5 * m + y % 5) for y in (2020, 2021) for m in range(1, 13)]})
    kept = ["entity", "year", "month_num", "yhat"]
    short = sorted(map(tuple, forecast_seasonal_arma(table, "entity", 2020, 2021).select(*kept).collect()))
    assert short == sorted(map(tuple, forecast_seasonal_ar(table, "entity", 2020, 2021).select(*kept).collect()))
    assert len(short) == 12 and all(r[3] > 0 for r in short)
