"""Shuffles and pushdown of the main plans."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from tallycast.operators import grids, ranking
from tallycast.plans.least_squares import forecast_ols
from tallycast.plans.seasonal_ar import forecast_seasonal_ar
from tallycast.plans.seasonal_trend import forecast_seasonal_trend
from tallycast.sources import star

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


def test_scan_reads_three_columns_and_pushes_the_year_range(spark, capsys):
    star.user_months(spark, FOLDER, 1999, 2000).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(l_shipdate,1999-01-01T00:00)" in plan and "LessThan(l_shipdate,2001-01-01T00:00)" in plan


@pytest.mark.parametrize(
    "forecast",
    [
        lambda m: forecast_ols(m, "username", 2001),
        lambda m: forecast_seasonal_trend(m, "username", target_year=2001),
        lambda m: forecast_seasonal_ar(m, "username", 1995, 2000),
        lambda m: grids.fill_months(m, "username", "timelog", 1995, 2000),
    ],
    ids=["least_squares", "seasonal_trend", "seasonal_ar", "fill_months"],
)
def test_a_forecast_is_one_shuffle_beyond_the_rollup(spark, forecast):
    keys = shuffles(forecast(star.user_months(spark, FOLDER, None, 2000)))
    assert len(keys) == 3
    assert sum("," in k.replace(", 4", "") for k in keys) == 2  # months by key, months by user, then the user alone


def test_regressors_add_no_shuffle(spark):
    monthly = star.user_months(spark, FOLDER, None, 2000).withColumn("x", F.col("month_num") * 2.0)
    forecast = forecast_seasonal_trend(monthly, "username", regressors=["x"], target_year=2001)
    assert len(shuffles(forecast)) == 3


def test_flagship_prunes_winners_before_the_shuffle(spark):
    forecast = forecast_ols(star.user_months(spark, FOLDER, None, 2000), "username", 2001)
    df = ranking.top_predicted(forecast, "username")
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") == 2 and len(shuffles(df)) == 4
    assert "partial_covar_pop" in plan


def test_rollup_beyond_broadcast_shuffles_sums_only(spark, no_broadcast):
    df = star.user_months(spark, FOLDER)
    plan = plan_of(df)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.rindex("partial_sum") > plan.index("SortMergeJoin")


def test_two_lookups_shuffle_raw_rows_never_and_scan_once(spark, no_broadcast):
    """Below the first sum lies the scan; every join and every later exchange moves sums."""
    from tallycast.operators import rollups
    from tallycast.workload import queries

    for name in ("b4_series_columns", "d3_project_user_totals", "d6_mean_project", "i8_seasonal_trend_regressor"):
        plan = plan_of(queries()[name](spark, FOLDER))
        scan = plan.rindex("l_suppkey")
        below = plan[plan.rindex("Exchange hashpartitioning", 0, scan) : scan]
        assert "partial_" in below and "Join" not in below, name
    df = rollups.user_months_with_project(star.cells(spark, FOLDER))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert final.count("l_suppkey#") and len(re.findall(r"FileScan parquet \[l_suppkey", final.split("Initial Plan")[0])) == 1
