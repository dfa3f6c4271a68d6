"""Queries for the chart-ready tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.operators import charts, filters, joins, ranking, rollups
from tallycast.plans.least_squares import forecast_ols
from tallycast.sources import star
from tallycast.storage import materialise
from tallycast.workload.common import (
    ALL_YEARS,
    LAST_TRAIN_YEAR,
    TARGET_YEAR,
    month_name_sql,
    ols_ctes,
    project_logs_cte,
    project_months_ctes,
    r4,
    round4,
    sql,
    tidy,
    user_months_ctes,
)
from tallycast.workload.data import query as _query

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    return _query(name, oracle, QUERIES)


_PROJECTS = project_months_ctes(None, LAST_TRAIN_YEAR)
_USERS = user_months_ctes(None, LAST_TRAIN_YEAR)


@query(
    "j1_project_history_and_forecast",
    sql(
        [*_PROJECTS, *ols_ctes("f", "project_months", "projectname", TARGET_YEAR, "cyclic")],
        f"""SELECT month_num, {month_name_sql("month_num")} AS month, CAST(year AS VARCHAR) AS series,
  CAST(sum(timelog) AS DOUBLE) AS value FROM project_months GROUP BY year, month_num
UNION ALL SELECT month_num, {month_name_sql("month_num")}, 'Predicted 2001', {r4("sum(yhat)")}
FROM f GROUP BY month_num""",
    ),
)
def j1_project_history_and_forecast(spark, folder):
    monthly = star.project_months(spark, folder, None, LAST_TRAIN_YEAR)
    forecast = forecast_ols(monthly, "projectname", TARGET_YEAR)
    predicted = rollups.totals(forecast, ["year", "month_num"], "yhat")
    return tidy(charts.series_with_forecast(rollups.monthly_total(monthly), predicted, TARGET_YEAR))


_TOP_USERS = """top_users AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, month_num
  ORDER BY timelog DESC, username) AS rn FROM user_months) WHERE rn = 1)"""
_TOP_PREDICTED = f"""top_predicted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, month_num
  ORDER BY yhat DESC, username) AS rn FROM (SELECT username, year, month_num, {r4("yhat")} AS yhat FROM f))
  WHERE rn = 1)"""


@query(
    "j1_top_user_history_and_forecast",
    sql(
        [*_USERS, *ols_ctes("f", "user_months", "username", TARGET_YEAR, "cyclic"), _TOP_USERS, _TOP_PREDICTED],
        f"""SELECT month_num, {month_name_sql("month_num")} AS month, CAST(year AS VARCHAR) AS series,
  CAST(timelog AS DOUBLE) AS value FROM top_users
UNION ALL SELECT month_num, {month_name_sql("month_num")}, 'Predicted 2001', yhat FROM top_predicted""",
    ),
)
def j1_top_user_history_and_forecast(spark, folder):
    monthly = star.user_months(spark, folder, None, LAST_TRAIN_YEAR)
    forecast = forecast_ols(monthly, "username", TARGET_YEAR).withColumn("yhat", round4("yhat"))
    return tidy(
        charts.series_with_forecast(
            ranking.top_user_per_month(monthly), ranking.top_predicted(forecast, "username"), TARGET_YEAR
        )
    )


def _matrix_columns(aggregate: str) -> str:
    # Spark takes the years from the data; columns of plain SQL have to be listed.
    return ", ".join(f'{aggregate}(CASE WHEN year = {y} THEN timelog END) AS "{y}"' for y in ALL_YEARS)


@query(
    "j2_top_user_matrix",
    sql([*user_months_ctes(), _TOP_USERS], f"SELECT month_num, {_matrix_columns('max')} FROM top_users GROUP BY 1"),
)
def j2_top_user_matrix(spark, folder):
    return charts.year_month_matrix(ranking.top_user_per_month(star.user_months(spark, folder)))


@query(
    "j3_month_total_matrix",
    sql(
        [
            project_logs_cte(),
            """month_totals AS (SELECT year, month_num, CAST(sum(timelog) AS BIGINT) AS timelog
  FROM project_logs GROUP BY year, month_num)""",
        ],
        f"SELECT month_num, {_matrix_columns('max')} FROM month_totals GROUP BY 1",
    ),
)
def j3_month_total_matrix(spark, folder):
    return charts.year_month_matrix(rollups.monthly_total(star.project_months(spark, folder)))


@query(
    "j4_period_labels",
    sql(
        [project_logs_cte()],
        """SELECT year, month_num, CASE WHEN year <= 1998 THEN '1995-1998' ELSE '1999-2001' END AS period,
  CASE WHEN year <= 1999 THEN '1995-1999' ELSE '2000-2001' END AS block, CAST(sum(timelog) AS BIGINT) AS timelog
FROM project_logs GROUP BY year, month_num""",
    ),
)
def j4_period_labels(spark, folder):
    return rollups.monthly_total(star.project_months(spark, folder)).withColumns(
        {
            "period": charts.period_label(F.col("year"), [(1995, 1998), (1999, 2001)]),
            "block": charts.block_label(F.col("year"), 1995, 2001, 5),
        }
    )


@query(
    "j5_predicted_project_series",
    sql(
        [*_PROJECTS, *ols_ctes("f", "project_months", "projectname", TARGET_YEAR, "cyclic")],
        f"""SELECT projectname, {month_name_sql("month_num")} AS month, {r4("yhat")} AS predicted_hours, year FROM f""",
    ),
)
def j5_predicted_project_series(spark, folder):
    monthly = star.project_months(spark, folder, None, LAST_TRAIN_YEAR)
    return tidy(filters.as_predictions(forecast_ols(monthly, "projectname", TARGET_YEAR), "projectname"))


_HOLDOUT_USERS = [
    *_USERS,
    "train AS (SELECT * FROM user_months WHERE year < 2000)",
    *ols_ctes("f", "train", "username", 2000, "cyclic"),
    _TOP_USERS,
    _TOP_PREDICTED,
]


@query(
    "j6_holdout_top_users",
    sql(
        _HOLDOUT_USERS,
        """SELECT p.year, p.month_num, p.yhat AS predicted, CAST(a.timelog AS DOUBLE) AS actual
FROM top_predicted p FULL OUTER JOIN (SELECT * FROM top_users WHERE year = 2000) a
ON p.year = a.year AND p.month_num = a.month_num""",
    ),
)
def j6_holdout_top_users(spark, folder):
    train, actual = filters.split_by_year(
        materialise(star.user_months(spark, folder, None, LAST_TRAIN_YEAR)), 1999
    )
    forecast = forecast_ols(train, "username", 2000).withColumn("yhat", round4("yhat"))
    return tidy(
        joins.align(
            ranking.top_predicted(forecast, "username"),
            ranking.top_user_per_month(actual),
            ["year", "month_num"],
        )
    )


@query(
    "j6_holdout_project_totals",
    sql(
        [
            *_PROJECTS,
            "train AS (SELECT * FROM project_months WHERE year < 2000)",
            *ols_ctes("f", "train", "projectname", 2000, "cyclic"),
            """actual AS (SELECT year, month_num, CAST(sum(timelog) AS DOUBLE) AS actual
  FROM project_months WHERE year = 2000 GROUP BY year, month_num)""",
            "predicted AS (SELECT year, month_num, sum(yhat) AS predicted FROM f GROUP BY year, month_num)",
        ],
        f"""SELECT year, month_num, {r4("predicted")} AS predicted, actual
FROM predicted FULL OUTER JOIN actual USING (year, month_num)""",
    ),
)
def j6_holdout_project_totals(spark, folder):
    train, actual = filters.split_by_year(
        materialise(star.project_months(spark, folder, None, LAST_TRAIN_YEAR)), 1999
    )
    keys = ["year", "month_num"]
    predicted = rollups.totals(forecast_ols(train, "projectname", 2000), keys, "yhat")
    return tidy(joins.align(predicted, rollups.monthly_total(actual), keys))
