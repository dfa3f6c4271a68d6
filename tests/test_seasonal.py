from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.plans.grouped import forecast_grouped
from tallycast.plans.seasonal_ar import forecast_seasonal_ar, forecast_seasonal_arma, seasonal_arma_batch
from tallycast.plans.seasonal_trend import forecast_seasonal_trend
from tests.conftest import rows


def seasonal_series(seed=8, years=range(2018, 2022), gaps=0.1):
    rng = random.Random(seed)
    out = {}
    for i in range(6):
        level, slope = rng.randint(80, 200), rng.uniform(-0.4, 0.8)
        shape = [rng.uniform(0.7, 1.3) for _ in range(12)]
        out[f"e{i}"] = [
            (y, m, max(1, int((level + slope * ((y - 2018) * 12 + m)) * shape[m - 1] + rng.randint(-5, 5))))
            for y in years
            for m in range(1, 13)
            if rng.random() > gaps
        ]
    return out


def predictions(forecast):
    out = {}
    for r in forecast.collect():
        out.setdefault(r.entity, {})[(r.year, r.month_num)] = r.yhat
    return out


def brute_seasonal_trend(points, periods=12):
    idx = np.array([y * 12 + m - 1 for y, m, *_ in points], float)
    value = np.array([p[2] for p in points], float)
    slope, level = np.polyfit(idx - 24000, value, 1)
    trend = level + slope * (idx - 24000)
    ratios = {}
    for i, t, v in zip(idx, trend, value):
        if t != 0:
            ratios.setdefault(int(i) % 12, []).append(v / t)
    means = {m: np.mean(r) for m, r in ratios.items()}
    scale = np.mean(list(means.values()))
    out = {}
    for h in range(1, periods + 1):
        k = int(idx.max()) + h
        out[(k // 12, k % 12 + 1)] = (level + slope * (k - 24000)) * (means[k % 12] / scale if k % 12 in means else 1.0)
    return out


def test_seasonal_trend_against_brute_force(monthly):
    series = seasonal_series()
    series["half_year"] = [(2020, m, 50 + m) for m in range(1, 7)]
    got = predictions(forecast_seasonal_trend(monthly(series), "entity"))
    for name, points in series.items():
        expected = brute_seasonal_trend(points)
        assert set(got[name]) == set(expected)
        assert np.allclose([got[name][k] for k in expected], list(expected.values())), name


def test_seasonal_index_averages_to_one(monthly):
    """A flat trend leaves the index alone: the year's forecasts average to the level."""
    shape = [8, 9, 10, 11, 12, 13, 12, 11, 10, 9, 8, 7]
    points = [(y, m, shape[m - 1]) for y in (2020, 2021) for m in range(1, 13)]
    got = forecast_seasonal_trend(monthly({"a": points}), "entity")
    rebuilt = brute_seasonal_trend(points)
    assert got.agg(F.avg("yhat")).first()[0] == pytest.approx(np.mean(list(rebuilt.values())))


def test_short_zero_and_early_series(monthly):
    series = {
        "single": [(2020, 1, 5)],
        "pair": [(2020, 1, 5), (2020, 2, 5)],
        "zeros": [(y, m, 0) for y in (2019, 2020) for m in range(1, 13)],
        "early": [(y, m, 9 + m) for y in (2019, 2020) for m in range(1, 13) if (y, m) != (2020, 12)],
    }
    got = predictions(forecast_seasonal_trend(monthly(series), "entity", target_year=2021))
    assert "single" not in got
    assert all(v == 0 for v in got["zeros"].values()) and len(got["zeros"]) == 12
    assert sorted(m for _, m in got["early"]) == list(range(1, 12))
    assert sorted(m for _, m in got["pair"]) == [1, 2]


def joint_least_squares(points, xs, x_future):
    """Ratio on month dummies and regressors, solved as one regression."""
    idx = np.array([y * 12 + m - 1 for y, m, *_ in points])
    value = np.array([p[2] for p in points], float)
    slope, level = np.polyfit(idx - 24000, value, 1)
    ratio = value / (level + slope * (idx - 24000))
    dummies = (idx[:, None] % 12 == np.arange(12)[None, :]).astype(float)
    x = np.column_stack(xs)
    coef = np.linalg.lstsq(np.column_stack([dummies, x]), ratio, rcond=None)[0]
    out = {}
    for h in range(1, 13):
        k = idx.max() + h
        season = coef[k % 12] + np.dot(coef[12:], x_future)
        out[(k // 12, k % 12 + 1)] = (level + slope * (k - 24000)) * season
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_regressors_against_joint_regression(spark, n):
    rng = random.Random(9)
    series, data = {}, []
    for name in ("a", "b"):
        points, xs = [], []
        for y in range(2017, 2021):
            for m in range(1, 13):
                x = [rng.uniform(1, 10), rng.uniform(0, 1), rng.uniform(-50, 50), *(rng.uniform(0, 900) for _ in range(3))][:n]
                value = int(1000 * (1 + 0.2 * np.sin(m)) * (1 + 0.02 * x[0]) + rng.randint(-20, 20))
                points.append((y, m, value))
                xs.append(x)
                data.append((name, y, m, value, *x))
        series[name] = (points, np.array(xs).T)
    names = [f"x{i}" for i in range(n)]
    schema = "entity string, year int, month_num int, timelog long, " + ", ".join(f"{x} double" for x in names)
    df = spark.createDataFrame(data, schema)
    got = predictions(forecast_seasonal_trend(df, "entity", regressors=names))
    given = {(y, m): [float(m), 0.5, -3.0, 7.0, 8.0, 9.0][:n] for y in (2021,) for m in range(1, 7)}
    future_schema = "entity string, year int, month_num int, " + ", ".join(f"{x} double" for x in names)
    future = spark.createDataFrame([("a", y, m, *x) for (y, m), x in given.items()], future_schema)
    with_future = predictions(forecast_seasonal_trend(df, "entity", regressors=names, future_x=future))
    for name, (points, xs) in series.items():
        mean = [x.mean() for x in xs]
        expected = joint_least_squares(points, xs, mean)
        assert np.allclose([got[name][k] for k in expected], list(expected.values()), rtol=1e-7)
        for k in expected:
            x_at = given.get(k, mean) if name == "a" else mean
            assert with_future[name][k] == pytest.approx(joint_least_squares(points, xs, x_at)[k], rel=1e-7)


def test_constant_regressor_changes_nothing(spark, monthly):
    df = monthly(seasonal_series())
    plain = forecast_seasonal_trend(df, "entity")
    with_x = forecast_seasonal_trend(df.withColumn("x", F.lit(4.0)), "entity", regressors=["x"])
    joined = plain.join(with_x.select("entity", "ds", F.col("yhat").alias("other")), ["entity", "ds"])
    # Without normalisation the level sits in the index; both have the same shape over the year.
    ratio = joined.groupBy("entity").agg(F.stddev_pop(F.col("yhat") / F.col("other")).alias("s"))
    assert joined.count() == 72 and ratio.agg(F.max("s")).first()[0] < 1e-9


def test_a_regressor_that_others_explain_changes_nothing(spark):
    rng = random.Random(4)
    data = [("a", y, m, rng.randint(500, 900), *(rng.uniform(0, 9) for _ in range(3))) for y in range(2017, 2021) for m in range(1, 13)]
    data = [(*r, r[4] + 2 * r[5] - r[6], 5.0) for r in data]
    df = spark.createDataFrame(data, "entity string, year int, month_num int, timelog long, x double, y double, z double, sum double, one double")
    plain = predictions(forecast_seasonal_trend(df, "entity", regressors=["x", "y", "z"]))
    more = predictions(forecast_seasonal_trend(df, "entity", regressors=["x", "one", "y", "z", "sum"]))
    assert list(more["a"]) == list(plain["a"]) and np.allclose(list(more["a"].values()), list(plain["a"].values()), rtol=1e-7)


def brute_seasonal_ar(points, first, last, periods):
    have = {(y, m): v for y, m, v in points}
    y = [float(have.get((yr, m), 0)) for yr in range(first, last + 1) for m in range(1, 13)]
    n = len(y)
    z = {t: y[t] - y[t - 12] for t in range(12, n)}
    cross = sum(z[t] * z[t - 1] for t in range(13, n))
    square = sum(z[t - 1] ** 2 for t in range(13, n))
    phi = 0.0 if n < 25 or square == 0 else max(-0.99, min(0.99, cross / square))
    path = list(y)
    ahead = z[n - 1] if n > 12 else 0.0
    for h in range(1, periods + 1):
        path.append(path[n + h - 1 - 12] + phi**h * ahead)
    return path[n:]


@pytest.mark.parametrize("periods", [12, 30])
def test_seasonal_ar_against_brute_force(monthly, periods):
    series = seasonal_series()
    series["constant"] = [(y, m, 100) for y in range(2018, 2022) for m in range(1, 13)]
    series["sparse"] = [(2021, 12, 40)]
    got = forecast_seasonal_ar(monthly(series), "entity", 2018, 2021, periods=periods)
    values = {}
    for r in got.orderBy("ds").collect():
        values.setdefault(r.entity, []).append(r.yhat)
    for name, points in series.items():
        assert np.allclose(values[name], brute_seasonal_ar(points, 2018, 2021, periods)), name


@pytest.mark.parametrize("years", [(2021, 2021), (2020, 2021)])
def test_seasonal_ar_short_grids_repeat_the_last_year(monthly, years):
    series = seasonal_series(gaps=0)
    got = predictions(forecast_seasonal_ar(monthly(series), "entity", *years))
    for name, points in series.items():
        last = {(y + 1, m): v for y, m, v in points if y == 2021}
        assert got[name] == last


def one_series_arma(y, periods):
    """The two-regression estimate for a single series, in plain loops."""
    w = [y[t] - y[t - 12] for t in range(12, len(y))]
    n = len(w)
    p = max(1, min(13, (n - 12) // 3))
    x = np.array([[w[t - i] for i in range(1, p + 1)] for t in range(p, n)])
    ar = np.linalg.lstsq(x, np.array(w[p:]), rcond=None)[0]
    e = [0.0] * n
    for t in range(p, n):
        e[t] = w[t] - sum(ar[i - 1] * w[t - i] for i in range(1, p + 1))
    x = np.array([[w[t - 1], e[t - 1], e[t - 12]] for t in range(p + 12, n)])
    phi, theta, seasonal = np.clip(np.linalg.lstsq(x, np.array(w[p + 12 :]), rcond=None)[0], -0.99, 0.99)
    a, path = [], list(w)

    def get(s, t):
        return s[t] if t >= 0 else 0.0

    for t in range(n + periods):
        mean = phi * get(path, t - 1) + theta * get(a, t - 1) + seasonal * get(a, t - 12) + theta * seasonal * get(a, t - 13)
        if t < n:
            a.append(path[t] - mean)
        else:
            path.append(mean)
            a.append(0.0)
    level = list(y)
    for h in range(periods):
        level.append(level[len(y) + h - 12] + path[n + h])
    return level[len(y) :]


def test_seasonal_arma_against_single_series_loops(monthly):
    series = seasonal_series(years=range(2015, 2022), gaps=0.05)
    got = forecast_seasonal_arma(monthly(series), "entity", 2015, 2021)
    values = {}
    for r in got.orderBy("ds").collect():
        values.setdefault(r.entity, []).append(r.yhat)
        assert r.fit_status == "ok"
    for name, points in series.items():
        have = {(y, m): v for y, m, v in points}
        grid = [float(have.get((y, m), 0)) for y in range(2015, 2022) for m in range(1, 13)]
        assert np.allclose(values[name], one_series_arma(grid, 12), rtol=1e-6), name


def test_seasonal_arma_recovers_a_known_process():
    rng = np.random.default_rng(10)
    n, phi, theta, seasonal = 1200, 0.7, 0.3, -0.4
    a = rng.normal(size=(4, n + 13))
    w = np.zeros((4, n + 13))
    for t in range(13, n + 13):
        w[:, t] = phi * w[:, t - 1] + a[:, t] + theta * a[:, t - 1] + seasonal * a[:, t - 12] + theta * seasonal * a[:, t - 13]
    y = np.zeros((4, n))
    for t in range(n):
        y[:, t] = w[:, t + 13] + (y[:, t - 12] if t >= 12 else 0)
    # One step ahead the error of the best forecast is the next shock; compare with it.
    predicted = seasonal_arma_batch(y, 1)[:, 0]
    best = y[:, n - 12] + phi * w[:, n + 12] + theta * a[:, n + 12] + seasonal * a[:, n + 1] + theta * seasonal * a[:, n]
    assert np.all(np.abs(predicted - best) < 0.5)


def test_seasonal_arma_degenerate_series(monthly):
    series = {"zeros": [(y, m, 0) for y in range(2018, 2022) for m in range(1, 13)], "once": [(2019, 5, 7)]}
    got = forecast_seasonal_arma(monthly(series), "entity", 2018, 2021)
    assert got.filter(F.isnan("yhat") | F.col("yhat").isNull()).count() == 0
    short = forecast_seasonal_arma(monthly(series), "entity", 2020, 2021)
    assert rows(short.groupBy("fit_status").agg(F.sum("yhat"))) == [("short_history", 0.0)]


def test_grouped_hook_passes_months_in_time_order(monthly):
    def first_and_last(series):
        return series.assign(first=series.timelog.iloc[0], last=series.timelog.iloc[-1])[["entity", "first", "last"]].head(1)

    df = monthly({"a": [(2021, 2, 9), (2020, 12, 1), (2021, 1, 5)], "b": [(2020, 1, 3)]})
    got = forecast_grouped(df.repartition(3), "entity", first_and_last, "entity string, first long, last long")
    assert rows(got) == [("a", 1, 9), ("b", 3, 3)]
