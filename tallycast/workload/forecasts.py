"""Queries for the forecast operators, their guards, and model evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallycast.operators import filters, grids, joins, quality, ranking, rollups
from tallycast.plans import evaluate, grouped, pooled, seasonal_ar, seasonal_trend
from tallycast.plans.least_squares import forecast_ols
from tallycast.sources import results, star
from tallycast.storage import materialise, scratch_path
from tallycast.workload.common import (
    FIRST_YEAR,
    LAST_TRAIN_YEAR,
    TARGET_YEAR,
    full_logs_cte,
    month_name_sql,
    ols_ctes,
    part_months_ctes,
    pooled_ar_ctes,
    pooled_hinge_ctes,
    project_months_ctes,
    r4,
    round4,
    seasonal_ar_ctes,
    seasonal_arma_ctes,
    seasonal_trend_ctes,
    solve_ctes,
    sql,
    tidy,
    user_months_ctes,
)
from tallycast.workload.data import query as _query

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    return _query(name, oracle, QUERIES)


def _users(spark, folder, last=LAST_TRAIN_YEAR):
    return star.user_months(spark, folder, None, last)


def _projects(spark, folder, last=LAST_TRAIN_YEAR):
    return star.project_months(spark, folder, None, last)


def _parts(spark, folder, first, last):
    """Monthly hours per part: short, gappy series that reach the guards."""
    return rollups.monthly_rollup(star.line_logs(spark, folder, first, last), "partkey")


def _forecast_rows(entity: str, source: str = "f", extra: str = "") -> str:
    return f"SELECT {entity}, year, month_num, {r4('yhat')} AS yhat, n_obs{extra} FROM {source}"


def _ols_sql(kind: str, base: list[str], source: str, entity: str) -> str:
    return sql(
        [*base, *ols_ctes("f", source, entity, TARGET_YEAR, kind)],
        _forecast_rows(entity, extra=", fit_status"),
    )


USER_TRAIN = user_months_ctes(None, LAST_TRAIN_YEAR)
PROJECT_TRAIN = project_months_ctes(None, LAST_TRAIN_YEAR)
_OLS_COLUMNS = ["year", "month_num", "yhat", "n_obs", "fit_status"]
_COLUMNS = ["year", "month_num", "yhat", "n_obs"]


# ---- I1-I4: least squares --------------------------------------------------------------


def _register_ols(name: str, kind: str) -> None:
    @query(f"{name}_users", _ols_sql(kind, USER_TRAIN, "user_months", "username"))
    def users(spark, folder):
        forecast = forecast_ols(_users(spark, folder), "username", TARGET_YEAR, features=kind)
        return tidy(forecast, "username", *_OLS_COLUMNS)

    @query(f"{name}_projects", _ols_sql(kind, PROJECT_TRAIN, "project_months", "projectname"))
    def projects(spark, folder):
        forecast = forecast_ols(_projects(spark, folder), "projectname", TARGET_YEAR, features=kind)
        return tidy(forecast, "projectname", *_OLS_COLUMNS)


_register_ols("i1_ols_ordinal", "ordinal")
_register_ols("i2_ols_cyclic", "cyclic")
_register_ols("i3_ols_rebased", "rebased")
_register_ols("i4_ols_standardised", "standardised")


@query(
    "i3_short_history_parts",
    sql(
        [*part_months_ctes(2000, 2000), *ols_ctes("f", "part_months", "partkey", TARGET_YEAR, "rebased")],
        _forecast_rows("partkey", extra=", fit_status"),
    ),
)
def i3_short_history_parts(spark, folder):
    forecast = forecast_ols(_parts(spark, folder, 2000, 2000), "partkey", TARGET_YEAR, features="rebased")
    return tidy(forecast, "partkey", *_OLS_COLUMNS)


@query(
    "i4_standardised_parts",
    sql(
        [*part_months_ctes(None, 2000), *ols_ctes("f", "part_months", "partkey", TARGET_YEAR, "standardised")],
        _forecast_rows("partkey", extra=", fit_status"),
    ),
)
def i4_standardised_parts(spark, folder):
    forecast = forecast_ols(_parts(spark, folder, None, 2000), "partkey", TARGET_YEAR, features="standardised")
    return tidy(forecast, "partkey", *_OLS_COLUMNS)


# ---- guards ----------------------------------------------------------------------------


@query(
    "b9_target_year_rows",
    sql(
        [*user_months_ctes()],
        """SELECT username, CAST((last_idx + h) // 12 AS INTEGER) AS year,
  CAST((last_idx + h) % 12 + 1 AS INTEGER) AS month_num
FROM (SELECT username, max(year * 12 + month_num - 1) AS last_idx FROM user_months GROUP BY username)
CROSS JOIN (SELECT range AS h FROM range(1, 13)) WHERE (last_idx + h) // 12 = 2002""",
    ),
)
def b9_target_year_rows(spark, folder):
    ahead = grids.future_months(star.user_months(spark, folder), "username", 12, "last_obs")
    return filters.target_year_only(ahead, 2002).select("username", "year", "month_num")


@query(
    "b10_min_history_guard",
    sql(
        [*part_months_ctes(2000, 2000), *ols_ctes("f", "part_months", "partkey", TARGET_YEAR, "cyclic")],
        _forecast_rows("partkey", extra=", fit_status"),
    ),
)
def b10_min_history_guard(spark, folder):
    forecast = forecast_ols(_parts(spark, folder, 2000, 2000), "partkey", TARGET_YEAR, features="cyclic")
    return tidy(forecast, "partkey", *_OLS_COLUMNS)


@query(
    "b10_drop_short_series",
    sql(
        [*part_months_ctes(2000, 2000), *seasonal_trend_ctes("f", "part_months", "partkey", TARGET_YEAR)],
        "SELECT partkey, count(*) AS n_rows FROM f GROUP BY partkey",
    ),
)
def b10_drop_short_series(spark, folder):
    """Series of one observation get no seasonal trend; later ones end their horizon in the target year."""
    forecast = seasonal_trend.forecast_seasonal_trend(
        _parts(spark, folder, 2000, 2000), "partkey", target_year=TARGET_YEAR
    )
    return forecast.groupBy("partkey").agg(F.count(F.lit(1)).alias("n_rows"))


_NAN_LOGS = """part_logs AS (SELECT l_partkey AS partkey, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(month(l_shipdate) AS INTEGER) AS month_num, l_quantity AS timelog, l_discount = 0 AS bad
  FROM lineitem WHERE year(l_shipdate) <= 2000)"""


@query(
    "b11_failed_fit_zero",
    sql(
        [
            _NAN_LOGS,
            "bad AS (SELECT partkey, max(CASE WHEN bad THEN 1 ELSE 0 END) AS bad FROM part_logs GROUP BY partkey)",
            """part_months AS (SELECT partkey, year, month_num, sum(timelog) AS timelog
  FROM part_logs GROUP BY partkey, year, month_num)""",
            *ols_ctes("f", "part_months", "partkey", TARGET_YEAR, "ordinal"),
        ],
        f"""SELECT partkey, year, month_num, CASE WHEN bad = 1 THEN 0 ELSE {r4("yhat")} END AS yhat, n_obs,
  CASE WHEN bad = 1 THEN 'failed' ELSE fit_status END AS fit_status FROM f JOIN bad USING (partkey)""",
    ),
)
def b11_failed_fit_zero(spark, folder):
    """A part with a broken (NaN) log value cannot be fitted and is predicted as 0."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").filter(
        F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    )
    logs = lines.select(
        F.col("l_partkey").alias("partkey"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month_num"),
        F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_quantity")).alias("timelog"),
    )
    forecast = forecast_ols(rollups.monthly_rollup(logs, "partkey"), "partkey", TARGET_YEAR, features="ordinal")
    return tidy(forecast, "partkey", *_OLS_COLUMNS)


@query(
    "b12_clamp_at_zero",
    sql(
        [*part_months_ctes(None, 2000), *ols_ctes("f", "part_months", "partkey", TARGET_YEAR, "ordinal")],
        f"SELECT partkey, year, month_num, {r4('unclamped')} AS unclamped, {r4('yhat')} AS clamped FROM f",
    ),
)
def b12_clamp_at_zero(spark, folder):
    """The forecast with its clamp beside the one without."""
    series, keys = _parts(spark, folder, None, LAST_TRAIN_YEAR), ["partkey", "year", "month_num"]
    both = [
        forecast_ols(series, "partkey", TARGET_YEAR, features="ordinal", clamp=clamp).select(
            *keys, F.col("yhat").alias(name)
        )
        for clamp, name in ((False, "unclamped"), (True, "clamped"))
    ]
    return tidy(both[0].join(both[1], keys))


@query(
    "b16_require_rows",
    sql(
        [*PROJECT_TRAIN, *ols_ctes("f", "project_months", "projectname", TARGET_YEAR, "cyclic")],
        "SELECT year, month_num, count(*) AS n_rows FROM f GROUP BY year, month_num",
    ),
)
def b16_require_rows(spark, folder):
    forecast = forecast_ols(_projects(spark, folder), "projectname", TARGET_YEAR)
    return (
        quality.require_rows(forecast).groupBy("year", "month_num").agg(F.count(F.lit(1)).alias("n_rows"))
    )


# ---- I5-I9: the other model families ----------------------------------------------------


@query(
    "i5_pooled_hinges",
    sql(
        [*USER_TRAIN, *pooled_hinge_ctes("f", "user_months", "username", TARGET_YEAR)],
        _forecast_rows("username", extra=", fit_status"),
    ),
)
def i5_pooled_hinges(spark, folder):
    forecast = pooled.forecast_pooled_hinges(_users(spark, folder), "username", TARGET_YEAR)
    return tidy(forecast, "username", *_OLS_COLUMNS)


@query("i5_pooled_trees")
def i5_pooled_trees(spark, folder):
    return tidy(pooled.forecast_pooled_gbt(_users(spark, folder), "username", TARGET_YEAR), "username", *_COLUMNS)


def _seasonal_ar_sql(base, source, entity):
    return sql(
        [*base, *seasonal_ar_ctes("f", source, entity, FIRST_YEAR, LAST_TRAIN_YEAR)], _forecast_rows(entity)
    )


@query("i6a_seasonal_ar_users", _seasonal_ar_sql(USER_TRAIN, "user_months", "username"))
def i6a_seasonal_ar_users(spark, folder):
    forecast = seasonal_ar.forecast_seasonal_ar(
        _users(spark, folder), "username", FIRST_YEAR, LAST_TRAIN_YEAR
    )
    return tidy(forecast, "username", *_COLUMNS)


@query("i6a_seasonal_ar_projects", _seasonal_ar_sql(PROJECT_TRAIN, "project_months", "projectname"))
def i6a_seasonal_ar_projects(spark, folder):
    forecast = seasonal_ar.forecast_seasonal_ar(
        _projects(spark, folder), "projectname", FIRST_YEAR, LAST_TRAIN_YEAR
    )
    return tidy(forecast, "projectname", *_COLUMNS)


@query(
    "i6b_seasonal_arma",
    sql(
        [*USER_TRAIN, *seasonal_arma_ctes("f", "user_months", "username", FIRST_YEAR, LAST_TRAIN_YEAR)],
        _forecast_rows("username"),
    ),
)
def i6b_seasonal_arma(spark, folder):
    forecast = seasonal_ar.forecast_seasonal_arma(
        _users(spark, folder), "username", FIRST_YEAR, LAST_TRAIN_YEAR
    )
    return tidy(forecast, "username", *_COLUMNS)


def _seasonal_trend_sql(base, source, entity):
    return sql([*base, *seasonal_trend_ctes("f", source, entity, TARGET_YEAR)], _forecast_rows(entity))


@query("i7_seasonal_trend_users", _seasonal_trend_sql(USER_TRAIN, "user_months", "username"))
def i7_seasonal_trend_users(spark, folder):
    forecast = seasonal_trend.forecast_seasonal_trend(
        _users(spark, folder), "username", target_year=TARGET_YEAR
    )
    return tidy(forecast, "username", *_COLUMNS)


@query("i7_seasonal_trend_projects", _seasonal_trend_sql(PROJECT_TRAIN, "project_months", "projectname"))
def i7_seasonal_trend_projects(spark, folder):
    forecast = seasonal_trend.forecast_seasonal_trend(
        _projects(spark, folder), "projectname", target_year=TARGET_YEAR
    )
    return tidy(forecast, "projectname", *_COLUMNS)


_REGRESSOR_CTES = [
    full_logs_cte(None, LAST_TRAIN_YEAR),
    """x_months AS (SELECT username, year * 12 + month_num - 1 - 24000 AS k, month_num,
  CAST(sum(timelog) AS DOUBLE) AS y, avg(projectid) AS x FROM full_logs GROUP BY username, year, month_num)""",
    """trend AS (SELECT username, regr_slope(y, k) AS slope, regr_intercept(y, k) AS level, max(k) AS last_k,
  count(*) AS n_obs, avg(x) AS x_bar FROM x_months GROUP BY username HAVING count(*) >= 2)""",
    """ratio AS (SELECT username, month_num, x, x_bar, y / nullif(level + slope * k, 0) AS r
  FROM x_months JOIN trend USING (username))""",
    """centred AS (SELECT *, avg(r) OVER w AS rm, avg(x) OVER w AS xm FROM ratio WHERE r IS NOT NULL
  WINDOW w AS (PARTITION BY username, month_num))""",
    """beta AS (SELECT username, coalesce(sum((r - rm) * (x - xm)) / nullif(sum((x - xm) * (x - xm)), 0), 0) AS b
  FROM centred GROUP BY username)""",
    """season AS (SELECT DISTINCT username, month_num, rm - b * (xm - x_bar) AS s
  FROM (SELECT username, month_num, x_bar, any_value(rm) AS rm, any_value(xm) AS xm FROM centred
    GROUP BY username, month_num, x_bar) JOIN beta USING (username))""",
    "mean_season AS (SELECT username, avg(s) AS s_bar FROM season GROUP BY username)",
    """ahead AS (SELECT username, level, slope, last_k + h AS k, CAST((24000 + last_k + h) // 12 AS INTEGER) AS year,
  CAST((24000 + last_k + h) % 12 + 1 AS INTEGER) AS month_num, n_obs
  FROM trend CROSS JOIN (SELECT range AS h FROM range(1, 13)))""",
]


@query(
    "i8_seasonal_trend_regressor",
    sql(
        _REGRESSOR_CTES,
        f"""SELECT a.username, a.year, a.month_num,
  {r4("(a.level + a.slope * a.k) * coalesce(s.s, m.s_bar, 1)")} AS yhat, a.n_obs
FROM ahead a LEFT JOIN season s ON a.username = s.username AND a.month_num = s.month_num
LEFT JOIN mean_season m ON a.username = m.username WHERE a.year = {TARGET_YEAR}""",
    ),
)
def i8_seasonal_trend_regressor(spark, folder):
    monthly = rollups.user_months_with_project(star.cells(spark, folder, None, LAST_TRAIN_YEAR))
    forecast = seasonal_trend.forecast_seasonal_trend(
        monthly, "username", regressors=["projectid"], target_year=TARGET_YEAR
    )
    return tidy(forecast, "username", *_COLUMNS)


_REGRESSORS = ["projectid", "n_rows", "n_projects", "top_hours"]
_FOUR_CTES = [
    full_logs_cte(None, LAST_TRAIN_YEAR),
    """cells AS (SELECT username, projectid, year, month_num, CAST(sum(timelog) AS DOUBLE) AS t, count(*) AS c
  FROM full_logs GROUP BY username, projectid, year, month_num)""",
    """x_months AS (SELECT username, year * 12 + month_num - 1 - 24000 AS k, month_num, sum(t) AS y,
  sum(projectid * c) / sum(c) AS x1, sum(c)::DOUBLE AS x2, count(projectid)::DOUBLE AS x3, max(t) AS x4
  FROM cells GROUP BY username, year, month_num)""",
    """trend AS (SELECT username, regr_slope(y, k) AS slope, regr_intercept(y, k) AS level, max(k) AS last_k,
  count(*) AS n_obs, avg(x1) AS b1, avg(x2) AS b2, avg(x3) AS b3, avg(x4) AS b4
  FROM x_months GROUP BY username HAVING count(*) >= 2)""",
    """ratio AS (SELECT username, month_num, x1, x2, x3, x4, y / nullif(level + slope * k, 0) AS r
  FROM x_months JOIN trend USING (username))""",
    """means AS (SELECT username, month_num, avg(r) AS rm, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4
  FROM ratio WHERE r IS NOT NULL GROUP BY username, month_num)""",
    """centred AS (SELECT username, [x1 - m1, x2 - m2, x3 - m3, x4 - m4, r - rm] AS v
  FROM ratio JOIN means USING (username, month_num) WHERE r IS NOT NULL)""",
    *solve_ctes("beta", "centred", "username", 4),
    """season AS (SELECT username, month_num, rm - coef[1] * (m1 - b1) - coef[2] * (m2 - b2) - coef[3] * (m3 - b3)
  - coef[4] * (m4 - b4) AS s FROM means JOIN trend USING (username) JOIN beta USING (username))""",
    *_REGRESSOR_CTES[-2:],
]


@query(
    "i8_four_regressors",
    sql(
        _FOUR_CTES,
        f"""SELECT a.username, a.year, a.month_num,
  {r4("(a.level + a.slope * a.k) * coalesce(s.s, m.s_bar, 1)")} AS yhat, a.n_obs
FROM ahead a LEFT JOIN season s ON a.username = s.username AND a.month_num = s.month_num
LEFT JOIN mean_season m ON a.username = m.username WHERE a.year = {TARGET_YEAR}""",
    ),
)
def i8_four_regressors(spark, folder):
    monthly = rollups.user_months_with_activity(star.cells(spark, folder, None, LAST_TRAIN_YEAR))
    forecast = seasonal_trend.forecast_seasonal_trend(
        monthly, "username", regressors=_REGRESSORS, target_year=TARGET_YEAR
    )
    return tidy(forecast, "username", *_COLUMNS)


@query(
    "i9_pooled_ar",
    sql(
        [*USER_TRAIN, *pooled_ar_ctes("f", "user_months", "username", FIRST_YEAR, LAST_TRAIN_YEAR)],
        _forecast_rows("username"),
    ),
)
def i9_pooled_ar(spark, folder):
    forecast = pooled.forecast_pooled_ar(
        _users(spark, folder), "username", TARGET_YEAR, first_year=FIRST_YEAR
    )
    return tidy(forecast, "username", *_COLUMNS)


@query(
    "i10_horizon_anchor",
    sql(
        part_months_ctes(None, LAST_TRAIN_YEAR),
        """SELECT partkey, count(*) AS n_rows, CAST(max((last_idx + h) % 12 + 1) AS INTEGER) AS last_month
FROM (SELECT partkey, max(year * 12 + month_num - 1) AS last_idx FROM part_months GROUP BY partkey)
CROSS JOIN (SELECT range AS h FROM range(1, 13)) WHERE (last_idx + h) // 12 = 2001 GROUP BY partkey""",
    ),
)
def i10_horizon_anchor(spark, folder):
    """Anchored at the last observation, a part that stopped early has fewer target-year months."""
    ahead = grids.future_months(_parts(spark, folder, None, LAST_TRAIN_YEAR), "partkey", 12, "last_obs")
    return (
        filters.target_year_only(ahead, TARGET_YEAR)
        .groupBy("partkey")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("month_num").alias("last_month"))
    )


_HOLT = (0.3, 0.1)  # smoothing of the level and of the trend


def smoothed_trend(series: pd.DataFrame) -> pd.DataFrame:
    """A user's own model for the grouped hook: level and trend smoothed exponentially. Each
    step needs the one before, which no aggregate function expresses."""
    a, b = _HOLT
    values = series["timelog"].to_numpy(float)
    level, trend = values[0], 0.0
    for y in values[1:]:
        before = level
        level = a * y + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
    months = pd.Series(range(1, 13), dtype="int32")
    return pd.DataFrame(
        {"username": series["username"].iloc[0], "year": TARGET_YEAR, "month_num": months, "yhat": level + months * trend}
    )


@query(
    "k2_grouped_hook",
    sql(
        [
            *USER_TRAIN,
            """ordered AS (SELECT username, CAST(timelog AS DOUBLE) AS y, row_number() OVER (
  PARTITION BY username ORDER BY year, month_num) AS t FROM user_months)""",
            f"""path AS (SELECT username, t, y AS level, CAST(0 AS DOUBLE) AS trend FROM ordered WHERE t = 1
  UNION ALL SELECT username, t, level, {_HOLT[1]} * (level - last_level) + (1 - {_HOLT[1]}) * trend FROM (
    SELECT p.username, o.t, p.level AS last_level, p.trend,
    {_HOLT[0]} * o.y + (1 - {_HOLT[0]}) * (p.level + p.trend) AS level
    FROM path p JOIN ordered o ON o.username = p.username AND o.t = p.t + 1))""",
            "line AS (SELECT username, arg_max(level, t) AS level, arg_max(trend, t) AS trend FROM path GROUP BY username)",
        ],
        f"""SELECT username, CAST({TARGET_YEAR} AS INTEGER) AS year, m.month_num,
  {r4("level + m.month_num * trend")} AS yhat
FROM line CROSS JOIN (SELECT CAST(range AS INTEGER) AS month_num FROM range(1, 13)) m""",
    ),
)
def k2_grouped_hook(spark, folder):
    return tidy(
        grouped.forecast_grouped(
            _users(spark, folder),
            "username",
            smoothed_trend,
            "username string, year int, month_num int, yhat double",
        )
    )


# ---- ranks and totals over predictions ---------------------------------------------------


def _top_predicted_sql(kind, base, source, entity):
    return sql(
        [*base, *ols_ctes("f", source, entity, TARGET_YEAR, kind)],
        f"""SELECT {entity}, month, predicted_hours, year FROM (SELECT *, row_number() OVER (PARTITION BY month
  ORDER BY predicted_hours DESC, {entity}) AS rn FROM (SELECT {entity}, {month_name_sql("month_num")} AS month,
  {r4("yhat")} AS predicted_hours, year FROM f)) WHERE rn = 1""",
    )


def _rounded(forecast):
    return forecast.withColumn("yhat", round4("yhat"))


@query("e3_top_predicted_user", _top_predicted_sql("cyclic", USER_TRAIN, "user_months", "username"))
def top_predicted_user(spark, folder):
    forecast = _rounded(forecast_ols(_users(spark, folder), "username", TARGET_YEAR))
    return filters.as_predictions(ranking.top_predicted(forecast, "username"), "username")


@query(
    "e3_skips_nan",
    sql(
        [*USER_TRAIN, *ols_ctes("f", "user_months", "username", TARGET_YEAR, "cyclic")],
        f"""SELECT username, month, predicted_hours, year FROM (SELECT *, row_number() OVER (PARTITION BY month
  ORDER BY predicted_hours DESC, username) AS rn FROM (SELECT username, {month_name_sql("month_num")} AS month,
  {r4("yhat")} AS predicted_hours, year FROM f
  WHERE CAST(right(username, 1) AS INTEGER) % 2 = 0 AND month_num <> 5)) WHERE rn = 1""",
    ),
)
def e3_skips_nan(spark, folder):
    """Failed predictions (NaN for odd users, null in May) never win; a month of failures has no winner."""
    forecast = forecast_ols(_users(spark, folder), "username", TARGET_YEAR).withColumn(
        "yhat",
        F.when(F.col("month_num") == 5, F.lit(None))
        .when(F.right("username", F.lit(1)).cast("int") % 2 == 1, F.lit(float("nan")))
        .otherwise(round4("yhat")),
    )
    return filters.as_predictions(ranking.top_predicted(forecast, "username"), "username")


@query("e4_top_predicted_project", _top_predicted_sql("ordinal", PROJECT_TRAIN, "project_months", "projectname"))
def e4_top_predicted_project(spark, folder):
    forecast = _rounded(forecast_ols(_projects(spark, folder), "projectname", TARGET_YEAR, features="ordinal"))
    return filters.as_predictions(ranking.top_predicted(forecast, "projectname"), "projectname")


@query(
    "a7_all_predictions",
    sql(
        [*USER_TRAIN, *ols_ctes("f", "user_months", "username", TARGET_YEAR, "rebased")],
        f"""SELECT username, {month_name_sql("month_num")} AS month, {r4("yhat")} AS predicted_hours, year FROM f""",
    ),
)
def a7_all_predictions(spark, folder):
    """Every prediction is written first; the reports then read the written table."""
    predictions = filters.as_predictions(
        forecast_ols(_users(spark, folder), "username", TARGET_YEAR, features="rebased"), "username"
    )
    base = scratch_path(spark, "results")
    results.write_result(predictions, base, "rebased", "2001", "all_users", fmt="parquet")
    again = results.read_result(spark, base, "rebased", "2001", "all_users", predictions.schema, "parquet")
    return tidy(again)


@query(
    "d8_predicted_month_totals",
    sql(
        [*PROJECT_TRAIN, *ols_ctes("f", "project_months", "projectname", TARGET_YEAR, "cyclic")],
        f"SELECT year, month_num, {r4('sum(yhat)')} AS yhat FROM f GROUP BY year, month_num",
    ),
)
def d8_predicted_month_totals(spark, folder):
    forecast = forecast_ols(_projects(spark, folder), "projectname", TARGET_YEAR)
    return tidy(rollups.totals(forecast, ["year", "month_num"], "yhat"))


@query(
    "g1_append_forecasts",
    sql(
        [
            *USER_TRAIN,
            *PROJECT_TRAIN,
            *ols_ctes("u", "user_months", "username", TARGET_YEAR, "cyclic"),
            *ols_ctes("p", "project_months", "projectname", TARGET_YEAR, "cyclic"),
        ],
        f"""SELECT 'user' AS model, username AS name, year, month_num, {r4("yhat")} AS yhat FROM u
UNION ALL SELECT 'project', projectname, year, month_num, {r4("yhat")} FROM p""",
    ),
)
def g1_append_forecasts(spark, folder):
    stacked = evaluate.stack_models(
        {
            "user": forecast_ols(_users(spark, folder), "username", TARGET_YEAR).withColumnRenamed(
                "username", "name"
            ),
            "project": forecast_ols(_projects(spark, folder), "projectname", TARGET_YEAR).withColumnRenamed(
                "projectname", "name"
            ),
        }
    )
    return tidy(stacked, "model", "name", "year", "month_num", "yhat")


# ---- I11-I13: evaluation ------------------------------------------------------------------

TEST_YEAR = LAST_TRAIN_YEAR


def _cyclic(entity):
    return lambda train: forecast_ols(train, entity, TEST_YEAR)


def _aligned_ctes(base, source, entity):
    return [
        *base,
        f"train AS (SELECT * FROM {source} WHERE year < {TEST_YEAR})",
        *ols_ctes("f", "train", entity, TEST_YEAR, "cyclic"),
        f"""aligned AS (SELECT coalesce(f.{entity}, a.{entity}) AS {entity}, coalesce(f.year, a.year) AS year,
  coalesce(f.month_num, a.month_num) AS month_num, f.yhat AS predicted, CAST(a.timelog AS DOUBLE) AS actual
  FROM f FULL OUTER JOIN (SELECT * FROM {source} WHERE year = {TEST_YEAR}) a
  ON f.{entity} = a.{entity} AND f.year = a.year AND f.month_num = a.month_num)""",
    ]


def _aligned_rows(entity):
    return f"SELECT {entity}, year, month_num, {r4('predicted')} AS predicted, actual FROM aligned"


_USERS_TO_2000 = user_months_ctes(None, TEST_YEAR)
_PROJECTS_TO_2000 = project_months_ctes(None, TEST_YEAR)


@query("i11_backtest_users", sql(_aligned_ctes(_USERS_TO_2000, "user_months", "username"), _aligned_rows("username")))
def i11_backtest_users(spark, folder):
    return tidy(evaluate.backtest(materialise(_users(spark, folder)), "username", TEST_YEAR, _cyclic("username")))


@query(
    "i11_backtest_projects",
    sql(_aligned_ctes(_PROJECTS_TO_2000, "project_months", "projectname"), _aligned_rows("projectname")),
)
def i11_backtest_projects(spark, folder):
    return tidy(evaluate.backtest(materialise(_projects(spark, folder)), "projectname", TEST_YEAR, _cyclic("projectname")))


@query(
    "c5_align_month_totals",
    sql(
        _aligned_ctes(_PROJECTS_TO_2000, "project_months", "projectname"),
        f"""SELECT year, month_num, {r4("sum(predicted)")} AS predicted, sum(actual) AS actual
FROM aligned GROUP BY year, month_num""",
    ),
)
def c5_align_month_totals(spark, folder):
    train, actual = filters.split_by_year(materialise(_projects(spark, folder)), TEST_YEAR - 1)
    keys = ["year", "month_num"]
    predicted = rollups.totals(forecast_ols(train, "projectname", TEST_YEAR), keys, "yhat")
    return tidy(joins.align(predicted, rollups.monthly_total(actual), keys))


_ERRORS = f"""count(*) AS n, {r4("avg((actual - predicted) * (actual - predicted))")} AS mse,
  {r4("sqrt(avg((actual - predicted) * (actual - predicted)))")} AS rmse, {r4("avg(abs(actual - predicted))")} AS mae,
  {r4("avg(abs(actual - predicted) / nullif(abs(actual), 0)) * 100")} AS mape"""
_BOTH = "actual IS NOT NULL AND predicted IS NOT NULL"


@query(
    "i12_accuracy_per_project",
    sql(
        _aligned_ctes(_PROJECTS_TO_2000, "project_months", "projectname"),
        f"SELECT projectname, {_ERRORS} FROM aligned WHERE {_BOTH} GROUP BY projectname",
    ),
)
def i12_accuracy_per_project(spark, folder):
    tested = evaluate.backtest(materialise(_projects(spark, folder)), "projectname", TEST_YEAR, _cyclic("projectname"))
    return tidy(evaluate.accuracy(tested, ["projectname"]))


@query(
    "i12_accuracy_overall",
    sql(
        _aligned_ctes(_USERS_TO_2000, "user_months", "username"),
        f"SELECT {_ERRORS} FROM aligned WHERE {_BOTH}",
    ),
)
def i12_accuracy_overall(spark, folder):
    tested = evaluate.backtest(materialise(_users(spark, folder)), "username", TEST_YEAR, _cyclic("username"))
    return tidy(evaluate.accuracy(tested))


@query(
    "i12_accuracy_month_totals",
    sql(
        [
            *_aligned_ctes(_PROJECTS_TO_2000, "project_months", "projectname"),
            """month_totals AS (SELECT year, month_num, sum(predicted) AS predicted, sum(actual) AS actual
  FROM aligned GROUP BY year, month_num)""",
        ],
        f"SELECT {_ERRORS} FROM month_totals WHERE {_BOTH}",
    ),
)
def i12_accuracy_month_totals(spark, folder):
    tested = evaluate.backtest(materialise(_projects(spark, folder)), "projectname", TEST_YEAR, _cyclic("projectname"))
    sums = [F.sum(c).alias(c) for c in ("predicted", "actual")]
    return tidy(evaluate.accuracy(tested.groupBy("year", "month_num").agg(*sums)))


_MODEL_CTES = [
    *_USERS_TO_2000,
    f"train AS (SELECT * FROM user_months WHERE year < {TEST_YEAR})",
    *ols_ctes("m1", "train", "username", TEST_YEAR, "ordinal"),
    *ols_ctes("m2", "train", "username", TEST_YEAR, "cyclic"),
    *seasonal_ar_ctes("m3", "train", "username", FIRST_YEAR, TEST_YEAR - 1),
    *seasonal_trend_ctes("m4", "train", "username", TEST_YEAR),
    *ols_ctes("m5", "train", "username", TEST_YEAR, "rebased"),
    *ols_ctes("m6", "train", "username", TEST_YEAR, "standardised"),
    *seasonal_arma_ctes("m7", "train", "username", FIRST_YEAR, TEST_YEAR - 1),
    *pooled_ar_ctes("m8", "train", "username", FIRST_YEAR, TEST_YEAR - 1),
    *pooled_hinge_ctes("m9", "train", "username", TEST_YEAR),
    "stacked AS ("
    + " UNION ALL ".join(
        f"SELECT '{model}' AS model, username, year, month_num, yhat FROM {cte}"
        for model, cte in [
            ("ordinal", "m1"),
            ("cyclic", "m2"),
            ("seasonal_ar", "m3"),
            ("seasonal_trend", "m4"),
            ("rebased", "m5"),
            ("standardised", "m6"),
            ("seasonal_arma", "m7"),
            ("pooled_ar", "m8"),
            ("pooled_hinges", "m9"),
        ]
    )
    + ")",
    f"""beside AS (SELECT s.model, s.username, s.yhat AS predicted, CAST(a.timelog AS DOUBLE) AS actual,
  a.timelog IS NOT NULL AND count(*) OVER (PARTITION BY s.username, s.year, s.month_num) = 9 AS compared
  FROM stacked s LEFT JOIN (SELECT * FROM user_months WHERE year = {TEST_YEAR}) a
  ON s.username = a.username AND s.year = a.year AND s.month_num = a.month_num)""",
    "aligned AS (SELECT * FROM beside WHERE compared)",
    "coverage AS (SELECT model, avg(CASE WHEN compared THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM beside GROUP BY model)",
]


def _compared(spark, folder):
    """The deterministic models of all families on one rollup, computed once and dealt out by user once."""
    monthly = materialise(_users(spark, folder))
    train, actual = filters.split_by_year(monthly, TEST_YEAR - 1)
    train = train.repartition("username")
    forecasts = {
        "ordinal": forecast_ols(train, "username", TEST_YEAR, features="ordinal"),
        "cyclic": forecast_ols(train, "username", TEST_YEAR),
        "seasonal_ar": seasonal_ar.forecast_seasonal_ar(train, "username", FIRST_YEAR, TEST_YEAR - 1),
        "seasonal_trend": seasonal_trend.forecast_seasonal_trend(train, "username", target_year=TEST_YEAR),
        "rebased": forecast_ols(train, "username", TEST_YEAR, features="rebased"),
        "standardised": forecast_ols(train, "username", TEST_YEAR, features="standardised"),
        "seasonal_arma": seasonal_ar.forecast_seasonal_arma(train, "username", FIRST_YEAR, TEST_YEAR - 1),
        "pooled_ar": pooled.forecast_pooled_ar(train, "username", TEST_YEAR, first_year=FIRST_YEAR),
        "pooled_hinges": pooled.forecast_pooled_hinges(train, "username", TEST_YEAR),
    }
    return evaluate.compare_models(forecasts, actual, "username")


@query(
    "i13_compare_models",
    sql(
        _MODEL_CTES,
        f"""SELECT * FROM (SELECT model, {_ERRORS} FROM aligned WHERE {_BOTH} GROUP BY model)
JOIN (SELECT model, {r4("coverage")} AS coverage FROM coverage) USING (model)""",
    ),
)
def i13_compare_models(spark, folder):
    return tidy(evaluate.model_errors(_compared(spark, folder)))


@query(
    "i13_best_model_per_user",
    sql(
        _MODEL_CTES,
        f"""SELECT username, model, rmse FROM (SELECT *, row_number() OVER (PARTITION BY username
  ORDER BY rmse, model) AS rn FROM (SELECT username, model, {_ERRORS} FROM aligned WHERE {_BOTH}
  GROUP BY username, model)) WHERE rn = 1""",
    ),
)
def i13_best_model_per_user(spark, folder):
    best = tidy(evaluate.best_model(_compared(spark, folder), "username"))
    return best.select("username", "model", "rmse")
