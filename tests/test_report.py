from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tallycast.operators.rollups import monthly_rollup
from tallycast.plans.least_squares import forecast_ols
from tallycast.plans.report import MODELS, run_report
from tallycast.schemas import NUMERIC_MONTH_LOGS
from tallycast.sources import timelogs
from tallycast.streaming import month_deltas, run_monthly_rollup, stream_logs
from tests.conftest import rows


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(12)
    data = []
    for y in range(2019, 2023):
        for m in range(1, 13):
            for u in range(1, 6):
                for _ in range(rng.randint(0, 3)):
                    p = rng.randint(1, 3)
                    day = f"{y}-{m:02d}-{rng.randint(1, 28):02d}"
                    data.append((f"user{u}", day, y, m, p, f"Project {p}", rng.randint(1, 40)))
    df = spark.createDataFrame(data, NUMERIC_MONTH_LOGS)
    return df.withColumn("date", F.to_date("date")).withColumnRenamed("month", "month_num").cache()


@pytest.mark.parametrize("model", ["cyclic", "seasonal_trend_regressor"])
def test_report_tables(spark, logs, tmp_path, model):
    paths = run_report(logs, str(tmp_path), "r1", model, 2019, 2022, backtest=True)
    read = {t: spark.read.option("header", True).csv(p) for t, p in paths.items()}
    assert read["historical_month_totals"].count() == 48
    assert read["historical_top_users"].columns == ["year", "month", "username", "timelog", "projectid"]
    assert read["top_user_per_project"].count() == 3
    # The seasonal trend runs twelve months from each project's own last month.
    last = logs.filter("year = 2022").groupBy("projectname").agg(F.max("month_num").alias("m"))
    expected = 36 if model == "cyclic" else last.agg(F.sum("m")).first()[0]
    assert read["all_projects_predictions"].count() == expected
    assert read["top_users_predictions"].columns == ["username", "month", "predicted_hours", "year"]
    assert rows(read["chart_projects"].groupBy("series").count())[-1] == ("Predicted 2023", 12)
    assert read["backtest_projects"].count() >= 33 and read["accuracy_users"].count() == 5
    assert rows(read["null_audit"].where("column = 'username'"), "null_count") == [("0",)]
    assert read["month_violations"].count() == 0
    over = logs.groupBy("username", "year", "month_num").agg(F.sum("timelog").alias("t")).where("t > 160").count()
    assert read["limit_violations"].count() == over
    assert read["matrix_month_totals"].columns == ["month", "2019", "2020", "2021", "2022"]
    total = logs.agg(F.sum("timelog")).first()[0]
    cells = read["matrix_month_totals"].selectExpr(*[f"CAST(`{y}` AS LONG) AS y{y}" for y in range(2019, 2023)]).collect()
    assert len(cells) == 12 and sum(v for r in cells for v in r) == total
    assert read["matrix_top_users"].count() == 12
    blocks = read["block_month_totals"].selectExpr("block", "CAST(timelog AS LONG) AS timelog")
    assert rows(blocks.groupBy("block").agg(F.sum("timelog"))) == [("2019-2022", total)]
    held = read["holdout_users"].orderBy(F.col("month_num").cast("int")).collect()
    assert len(held) == 12 and all(r.first_actual and r.first_predicted for r in held)
    actual = logs.where("year = 2022").groupBy("month_num").agg(F.sum("timelog").alias("t"))
    assert {r.month_num: r.t for r in actual.collect()} == {int(r.month_num): int(float(r.actual)) for r in held if r.actual}
    if model == "cyclic":
        direct = forecast_ols(monthly_rollup(logs, "projectname"), "projectname", 2023)
        written = read["all_projects_predictions"].select(
            "projectname", F.col("month_num").cast("int"), F.col("yhat").cast("double").alias("written")
        )
        both = direct.join(written, ["projectname", "month_num"])
        assert both.count() == 36
        assert both.filter(F.abs(F.col("yhat") - F.col("written")) > 1e-6).count() == 0


@pytest.mark.parametrize("model", sorted(MODELS))
def test_every_model_predicts_every_user(logs, model):
    users = monthly_rollup(logs, "username")
    forecast = MODELS[model](users, "username", 2019, 2023)
    got = forecast.groupBy("username").agg(F.count_if(F.col("yhat").isNotNull() & ~F.isnan("yhat")).alias("n")).collect()
    assert len(got) == 5 and all(r.n >= 10 for r in got)
    assert forecast.columns == ["username", "ds", "year", "month_num", "yhat", "n_obs", "fit_status"]


def test_report_fails_without_rows(logs, tmp_path):
    with pytest.raises(ValueError):
        run_report(logs, str(tmp_path), "r1", "cyclic", 1990, 1991)


def test_stream_of_files_equals_batch(spark, logs, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)
    parts = logs.randomSplit([0.4, 0.3, 0.3], seed=1)
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        run_monthly_rollup(stream_logs(spark, source, logs.schema), "username", out)
        if i == 1:  # nothing new arrived: nothing is counted twice
            run_monthly_rollup(stream_logs(spark, source, logs.schema), "username", out)
    assert rows(month_deltas(spark, "username", out)) == rows(monthly_rollup(logs, "username"))


def test_logs_written_by_one_layout_feed_a_report(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    timelogs.write_timelogs(logs, path, "csv", "text_month")
    again = timelogs.read_timelogs(spark, path, "csv", "text_month")
    paths = run_report(again, str(tmp_path / "o"), "r", "ordinal", 2019, 2022, fmt="parquet")
    assert spark.read.parquet(paths["all_users_predictions"]).count() == 60


def test_report_counts_rows_with_one_side_and_reports_bad_months(spark, logs, tmp_path):
    odd = spark.sql(
        """SELECT 'user1' AS username, DATE'2021-03-01' AS date, 2021 AS year, 3 AS month_num,
        CAST(NULL AS INT) AS projectid, CAST(NULL AS STRING) AS projectname, 500L AS timelog
        UNION ALL SELECT NULL, DATE'2021-03-01', 2021, 3, 1, 'Project 1', 9L
        UNION ALL SELECT 'user1', NULL, 2021, NULL, 1, 'Project 1', 1L"""
    )
    own = logs.select(*odd.columns)
    paths = run_report(own.unionByName(odd), str(tmp_path), "odd", "cyclic", 2019, 2022)
    read = {t: spark.read.option("header", True).csv(p) for t, p in paths.items()}
    before = own.where("username = 'user1' AND year = 2021 AND month_num = 3").agg(F.sum("timelog")).first()[0] or 0
    top = read["historical_top_users"].where("year = 2021 AND month = 'Mar'").first()
    assert (top.username, int(top.timelog)) == ("user1", before + 500)
    assert rows(read["limit_violations"].where("year = 2021 AND month = 'Mar'"), "username") == [("user1",)]
    assert rows(read["month_violations"], "reason", "n_rows") == [("month missing", "1")]
    assert {r["column"]: int(r.null_count) for r in read["null_audit"].collect() if r.null_count != "0"} == {
        "username": 1, "date": 1, "month_num": 1, "projectid": 1, "projectname": 1
    }
    project = own.where("projectname = 'Project 1' AND year = 2021 AND month_num = 3").agg(F.sum("timelog")).first()[0] or 0
    got = read["historical_projects"].where("year = 2021 AND month = 'Mar' AND projectname = 'Project 1'").first()
    assert int(got.timelog) == project + 9
