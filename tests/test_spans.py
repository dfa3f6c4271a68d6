"""Spans taken from the data, plans that run once, and reports over several models and regressors."""

from __future__ import annotations

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallycast.operators import charts, grids, quality, rollups
from tallycast.plans import evaluate
from tallycast.plans.least_squares import forecast_ols
from tallycast.plans.report import run_report
from tests.conftest import rows


def counted(df, counter):
    """The table, with its rows counted as they are computed."""

    def run(batches):
        for batch in batches:
            counter.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema)


def test_no_year_is_lost(spark, monthly):
    table = monthly({"a": [(1990, 3, 5), (2001, 1, 7)], "b": [(2010, 12, 9)]})
    assert list(rollups.year_span(table)) == list(range(1990, 2011)) and not rollups.year_span(table.limit(0))
    grid = grids.fill_span(table, "entity")
    assert grid.count() == 2 * 21 * 12 and grid.agg(F.sum("timelog")).first()[0] == 21
    assert rows(grid.filter("observed"), "entity", "year", "month_num", "timelog") == rows(table, "entity", "year", "month_num", "timelog")
    matrix = charts.year_month_matrix(rollups.monthly_total(table))
    assert matrix.columns == ["month_num", *map(str, range(1990, 2011))]
    found = {(r.month_num, y): r[str(y)] for r in matrix.collect() for y in range(1990, 2011) if r[str(y)] is not None}
    assert found == {(3, 1990): 5, (1, 2001): 7, (12, 2010): 9}
    days = spark.createDataFrame([("a", date(1990, 5, 1)), ("b", date(2010, 2, 3))], "who string, date date")
    assert grids.day_scaffold(days, "who").groupBy("who").count().collect()[0]["count"] == 21 * 365 + 5


def test_spans_of_empty_tables(monthly):
    none = monthly({"a": [(2000, 1, 1)]}).limit(0)
    assert grids.fill_span(none, "entity").count() == 0
    assert charts.year_month_matrix(none).count() == 0
    assert grids.day_scaffold(none.withColumn("date", F.current_date()), "entity").count() == 0


def test_required_rows_are_computed_once(spark, monthly):
    counter = spark.sparkContext.accumulator(0)
    table = quality.require_rows(counted(monthly({"a": [(2000, m, m) for m in range(1, 9)]}), counter))
    assert table.count() == 8 and table.agg(F.sum("timelog")).first()[0] == 36
    assert counter.value == 8
    with pytest.raises(ValueError, match="no rows: forecast"):
        quality.require_rows(table.filter("year = 1"))


def test_models_are_computed_once_for_all_comparisons(spark, monthly):
    series = monthly({e: [(y, m, 100 + m * k) for y in (2018, 2019, 2020) for m in range(1, 13)] for k, e in enumerate("abc")})
    counter = spark.sparkContext.accumulator(0)
    train, actual = series.filter("year < 2020"), series.filter("year = 2020")
    forecasts = {k: counted(forecast_ols(train, "entity", 2020, features=k), counter) for k in ("ordinal", "cyclic")}
    compared = evaluate.compare_models(forecasts, actual, "entity")
    errors, best = evaluate.model_errors(compared).collect(), evaluate.best_model(compared, "entity").collect()
    assert len(errors) == 2 and len(best) == 3
    assert counter.value == 2 * 3 * 12  # each model's rows, once


@pytest.fixture
def logs(spark):
    days = pd.date_range("2017-01-01", "2019-12-31", freq="5D")
    data = [(f"u{k}", d.date(), d.year, d.month, k % 2, f"p{k % 2}", 5 + (d.month * (k + 1)) % 9) for k in range(3) for d in days]
    return spark.createDataFrame(data, "username string, date date, year int, month_num int, projectid int, projectname string, timelog long")


def test_report_with_outside_regressors(spark, logs, tmp_path):
    """Values known for the year ahead move the forecast of the users that have them."""
    months = [(f"u{k}", y, m, float((y * m * (k + 2)) % 7), float((m + y) % 3)) for k in range(3) for y in (2017, 2018, 2019) for m in range(1, 13)]
    known = spark.createDataFrame(months, "username string, year int, month_num int, price double, staff double")
    ahead = spark.createDataFrame([("u1", 2020, m, 50.0, 9.0) for m in range(1, 13)], known.schema)
    found = {}
    for name, future in (("mean", None), ("given", ahead)):
        paths = run_report(
            logs, str(tmp_path / name), "r", "seasonal_trend_regressor", 2017, 2019, fmt="parquet",
            regressors=["price", "staff"], monthly_x=known, future_x=future,
        )
        out = spark.read.parquet(paths["all_users_predictions"])
        found[name] = {(r.username, r.month_num): r.yhat for r in out.collect()}
    assert len(found["mean"]) == 36 and found["mean"].keys() == found["given"].keys()
    for key, value in found["mean"].items():
        assert (abs(found["given"][key] - value) > 1e-6) == (key[0] == "u1")
