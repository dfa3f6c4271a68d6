from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.functions.calendar import CYCLIC_SQL
from tallycast.plans import evaluate
from tallycast.plans.least_squares import fit, forecast_ols
from tests.conftest import rows

# Published monthly hours of one project, 2020-2024, and the published least-squares
# predictions for 2024 (from 2020-2023) and 2025 (from 2020-2024). Fixed values.
HISTORY = {
    2020: [15324, 12077, 14181, 13891, 14532, 13350, 11454, 13524, 13953, 12292, 12644, 11190],
    2021: [10757, 11849, 13330, 13485, 15022, 11172, 13054, 12217, 9910, 11914, 10248, 16845],
    2022: [11138, 13693, 13804, 12940, 13299, 12794, 14466, 12176, 14367, 15209, 11108, 12813],
    2023: [10685, 12190, 13789, 11465, 15213, 11021, 11648, 9058, 10306, 12057, 9994, 12483],
    2024: [11016, 10901, 12821, 11975, 12901, 11408, 14511, 14604, 9264, 12243, 12511, 11389],
}
PREDICTED_2024 = [
    11646.760285867727, 12001.36240852368, 12257.496576837264, 12346.531847254606,
    12244.611290969537, 11979.044438730809, 11620.989714132273, 11266.38759147632,
    11010.253423162736, 10921.218152745394, 11023.138709030463, 11288.705561269191,
]
PREDICTED_2025 = [
    11472.98001026467, 11801.396379320184, 12084.914365522214, 12247.565553428372,
    12245.767688590917, 12080.002507441444, 11794.686656402075, 11466.27028734656,
    11182.75230114453, 11020.101113238372, 11021.898978075827, 11187.6641592253,
]


def golden(years):
    return {"p": [(y, m + 1, v) for y in years for m, v in enumerate(HISTORY[y])]}


@pytest.mark.parametrize("kind", ["cyclic", "rebased"])
@pytest.mark.parametrize("last,expected", [(2023, PREDICTED_2024), (2024, PREDICTED_2025)])
def test_golden_values(monthly, kind, last, expected):
    forecast = forecast_ols(monthly(golden(range(2020, last + 1))), "entity", last + 1, features=kind)
    got = [r.yhat for r in forecast.orderBy("month_num").collect()]
    assert np.allclose(got, expected, rtol=0, atol=1e-8)


def design(points, kind, target):
    x = []
    for y, m, *_ in points:
        if kind in ("ordinal", "standardised"):
            x.append([y, m])
        else:
            x.append([y, math.sin(2 * math.pi * m / 12), math.cos(2 * math.pi * m / 12)])
    return np.array(x, float)


def expected_fit(points, kind, target):
    """Centred minimum-norm least squares, then the twelve target months, clamped."""
    x, y = design(points, kind, target), np.array([p[2] for p in points], float)
    scale = np.ones(x.shape[1])
    if kind == "standardised":
        scale = x.std(axis=0)
        scale[scale == 0] = 1
    xc, yc = (x - x.mean(axis=0)) / scale, y - y.mean()
    w = np.linalg.lstsq(xc, yc, rcond=1e-9)[0]
    at = (design([(target, m) for m in range(1, 13)], kind, target) - x.mean(axis=0)) / scale
    return np.maximum(y.mean() + at @ w, 0)


def awkward_series():
    rng = random.Random(7)

    def value():
        return rng.randint(0, 200)

    every = [(y, m) for y in range(2019, 2023) for m in range(1, 13)]
    out = {f"n{n}": [(y, m, value()) for y, m in rng.sample(every, n)] for n in (1, 2, 3, 5, 6, 12, 13, 48)}
    for i in range(30):
        n = rng.randint(1, 9)
        out[f"random{i}"] = [(y, m, value()) for y, m in rng.sample(every, n)]
    out["one_year"] = [(2022, m, value()) for m in range(1, 13)]
    out["two_months"] = [(y, m, value()) for y in range(2019, 2023) for m in (3, 9)]
    out["one_month"] = [(y, 5, value()) for y in range(2019, 2023)]
    out["opposite"] = [(2022, 3, 10), (2022, 9, 30), (2021, 3, 20)]
    out["collinear"] = [(2019 + i, 1 + i, 10 * i + rng.randint(0, 3)) for i in range(4)]
    out["constant"] = [(y, m, 100) for y, m in every]
    out["zeros"] = [(y, m, 0) for y, m in every]
    out["falling"] = [(y, m, max(0, 5000 - 1200 * (y - 2019) - 10 * m)) for y, m in every]
    out["negative"] = [(y, m, -value()) for y, m in every[:20]]
    return out


@pytest.mark.parametrize("kind", ["ordinal", "standardised", "cyclic", "rebased"])
def test_every_awkward_series_against_numpy(monthly, kind):
    series = awkward_series()
    forecast = forecast_ols(monthly(series), "entity", 2023, features=kind)
    got = {}
    for r in forecast.collect():
        got.setdefault(r.entity, {})[r.month_num] = (r.yhat, r.fit_status, r.n_obs)
    least = {"ordinal": 1, "standardised": 1, "cyclic": 3, "rebased": 6}[kind]
    assert set(got) == set(series)
    for name, points in series.items():
        values = [got[name][m][0] for m in range(1, 13)]
        status = got[name][1][1]
        assert got[name][1][2] == len(points)
        if len(points) < least:
            mean = np.mean([p[2] for p in points]) * 1.05 if kind == "rebased" else 0
            assert np.allclose(values, mean) and status == "short_history", name
        else:
            assert np.allclose(values, expected_fit(points, kind, 2023), atol=1e-6), name
            assert status in ("ok", "rank_deficient")
    assert got["one_year"][1][1] == "rank_deficient" and got["n48"][1][1] == "ok"


def test_clamp_and_its_absence(monthly):
    df = monthly({"falling": awkward_series()["falling"]})
    assert forecast_ols(df, "entity", 2030).agg(F.max("yhat")).first()[0] == 0.0
    assert forecast_ols(df, "entity", 2030, clamp=False).agg(F.max("yhat")).first()[0] < 0


def test_exact_line_is_recovered(spark):
    data = [
        ("a", y, m, 10 + 2.0 * (y - 2020) + 3 * math.sin(2 * math.pi * m / 12) + 4 * math.cos(2 * math.pi * m / 12))
        for y in range(2020, 2025)
        for m in range(1, 13)
    ]
    df = spark.createDataFrame(data, "entity string, year int, month_num int, v double")
    waves = [wave.format(month="month_num") for wave in CYCLIC_SQL]
    row = fit(df, ["entity"], ["year - 2020", *waves], "v").first()
    assert np.allclose([row.coef_0, row.coef_1, row.coef_2], [2, 3, 4], atol=1e-10) and row.rank == 3


def test_year_origin_does_not_matter(monthly):
    points = [(y, m, 100 + 5 * y % 17 + m) for y in range(2015, 2020) for m in range(1, 13)]
    shifted = [(y + 300, m, v) for y, m, v in points]
    a = forecast_ols(monthly({"e": points}), "entity", 2020).orderBy("month_num").collect()
    b = forecast_ols(monthly({"e": shifted}), "entity", 2320).orderBy("month_num").collect()
    assert np.allclose([r.yhat for r in a], [r.yhat for r in b], atol=1e-9)


def test_non_finite_fit_becomes_zero(spark):
    data = [("bad", 2020, m, float("nan") if m == 3 else 5.0) for m in range(1, 13)]
    data += [("inf", 2020, m, float("inf") if m == 3 else 5.0) for m in range(1, 13)]
    data += [("good", 2020, m, 5.0) for m in range(1, 13)]
    df = spark.createDataFrame(data, "entity string, year int, month_num int, timelog double")
    got = forecast_ols(df, "entity", 2021).groupBy("entity", "fit_status").agg(F.round(F.sum("yhat"), 6))
    assert rows(got) == [("bad", "failed", 0.0), ("good", "rank_deficient", 60.0), ("inf", "failed", 0.0)]


def test_backtest_accuracy_and_comparison(monthly):
    df = monthly(golden(range(2020, 2025)))
    tested = evaluate.backtest(df, "entity", 2024, lambda train: forecast_ols(train, "entity", 2024))
    actual, predicted = np.array(HISTORY[2024], float), np.array(PREDICTED_2024)
    row = evaluate.accuracy(tested).first()
    assert row.n == 12
    assert row.rmse == pytest.approx(math.sqrt(np.mean((actual - predicted) ** 2)))
    assert row.mae == pytest.approx(np.mean(np.abs(actual - predicted)))
    assert row.mape == pytest.approx(np.mean(np.abs(actual - predicted) / actual) * 100)

    train, held = df.filter("year < 2024"), df.filter("year = 2024")
    forecasts = {k: forecast_ols(train, "entity", 2024, features=k) for k in ("ordinal", "cyclic")}
    aligned = evaluate.compare_models(forecasts, held, "entity")
    errors = {r.model: r.rmse for r in evaluate.accuracy(aligned, ["model"]).collect()}
    best = evaluate.best_model(aligned, "entity").first()
    assert best.model == min(errors, key=errors.get) and best.rmse == pytest.approx(min(errors.values()))
    with pytest.raises(ValueError):
        evaluate.stack_models({})


def test_mape_leaves_out_zero_months(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 8.0), (None, 1.0), (3.0, None)], "actual double, predicted double")
    row = evaluate.accuracy(df).first()
    assert row.n == 2 and row.mape == pytest.approx(20.0) and row.mae == pytest.approx(3.5)
