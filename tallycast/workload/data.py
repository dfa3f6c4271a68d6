"""Queries for sources, filters, joins, aggregations, ranks, sorts, scalars, grids and apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycast.functions import calendar as cal
from tallycast.functions import numeric as num
from tallycast.operators import apportion as app
from tallycast.operators import filters, grids, joins, quality, ranking, rollups, scaling, windows
from tallycast.sources import results, star, timelogs
from tallycast.storage import materialise, scratch_path
from tallycast.streaming import rollup as rollup_stream
from tallycast.workload.common import (
    FIRST_YEAR,
    MONTH_LIST,
    TARGET_YEAR,
    full_logs_cte,
    grid_ctes,
    month_name_sql,
    part_months_ctes,
    project_logs_cte,
    project_months_ctes,
    r4,
    rollup_cte,
    sql,
    tidy,
    user_logs_cte,
    user_months_ctes,
)

QUERIES: dict = {}


def query(name: str, oracle: str | None = None, into: dict = QUERIES):
    def register(fn):
        into[name] = (fn, oracle)
        return fn

    return register


# ---- A: sources and sinks -------------------------------------------------------------

_LOG_SUMMARY = sql(
    [full_logs_cte()],
    """SELECT year, month_num, count(*) AS n_rows, CAST(sum(timelog) AS BIGINT) AS timelog,
  strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date,
  count(DISTINCT username) AS n_users, count(DISTINCT projectname) AS n_projects
FROM full_logs GROUP BY year, month_num""",
)


def _log_round_trip(spark: SparkSession, folder: str, fmt: str, layout: str) -> DataFrame:
    """Logs of keys, written by year and read back. Names come to sums, so that no join moves single rows."""
    path = scratch_path(spark, f"logs-{fmt}-{layout}")
    keys = star.line_logs(spark, folder).withColumns(
        {
            "username": F.col("suppkey").cast("string"),
            "projectid": F.lit(None).cast("int"),
            "projectname": F.col("partkey").cast("string"),
        }
    )
    timelogs.write_timelogs(keys, path, fmt, layout, by_year=True)
    logs = timelogs.read_timelogs(spark, path, fmt, layout)
    sums = logs.groupBy("username", "projectname", "year", "month_num").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("timelog").alias("timelog"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    keyed = sums.withColumns({"suppkey": F.col("username").cast("long"), "partkey": F.col("projectname").cast("long")})
    keyed = keyed.drop("username", "projectname")
    named = joins.lookup(joins.lookup(keyed, star.suppliers(spark, folder), "suppkey"), star.parts(spark, folder), "partkey")
    return tidy(
        named.groupBy("year", "month_num").agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("timelog").alias("timelog"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
            F.count_distinct("username").alias("n_users"),
            F.count_distinct("projectname").alias("n_projects"),
        )
    )


@query("a1_read_timelogs_csv", _LOG_SUMMARY)
def a1_read_timelogs_csv(spark, folder):
    return _log_round_trip(spark, folder, "csv", "numeric_month")


@query("a1_read_timelogs_text_month", _LOG_SUMMARY)
def a1_read_timelogs_text_month(spark, folder):
    return _log_round_trip(spark, folder, "csv", "text_month")


@query("a1_read_timelogs_parquet", _LOG_SUMMARY)
def a1_read_timelogs_parquet(spark, folder):
    return _log_round_trip(spark, folder, "parquet", "numeric_month")


@query(
    "a2_parse_date",
    """SELECT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS date, count(*) AS n_rows
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)""",
)
def a2_parse_date(spark, folder):
    text = star.line_logs(spark, folder).select(F.date_format("date", "yyyy-MM-dd").alias("date"))
    return tidy(timelogs.parse_date(text).groupBy("date").agg(F.count(F.lit(1)).alias("n_rows")))


@query(
    "a3_write_result_csv",
    sql(user_months_ctes(), "SELECT username, year, month_num, timelog FROM user_months"),
)
def a3_write_result_csv(spark, folder):
    monthly = star.user_months(spark, folder)
    base = scratch_path(spark, "results")
    results.write_result(monthly, base, "history", "full", "user_months")
    return results.read_result(spark, base, "history", "full", "user_months", monthly.schema)


@query(
    "a4_versioned_results",
    sql(
        [user_logs_cte(), project_logs_cte()],
        """SELECT 'history' AS model, 'by_user' AS run, username AS name, CAST(sum(timelog) AS BIGINT) AS timelog
FROM user_logs GROUP BY username
UNION ALL SELECT 'history', 'by_project', projectname, CAST(sum(timelog) AS BIGINT)
FROM project_logs GROUP BY projectname""",
    ),
)
def a4_versioned_results(spark, folder):
    table = f"{scratch_path(spark, 'results')}/totals"
    users = star.user_totals(spark, folder).withColumnRenamed("username", "name")
    projects = star.project_totals(spark, folder).withColumnRenamed("projectname", "name")
    results.write_run(users, table, "history", "by_user")
    results.write_run(projects, table, "history", "by_project")
    return results.read_run_table(spark, table, users.schema)


@query(
    "a4_read_runs_checked",
    sql(
        project_months_ctes(),
        """SELECT 'history' AS model, CASE WHEN year <= 1999 THEN 'early' ELSE 'late' END AS run, projectname,
  CAST(sum(timelog) AS BIGINT) AS timelog, count(*) AS n_rows FROM project_months GROUP BY 1, 2, 3""",
    ),
)
def a4_read_runs_checked(spark, folder):
    """Two runs of one table, read together with their headers and cells checked."""
    monthly, base = materialise(star.project_months(spark, folder)), scratch_path(spark, "results")
    for run, part in (("early", monthly.filter("year <= 1999")), ("late", monthly.filter("year > 1999"))):
        results.write_result(part, base, "history", run, "project_months")
    read = results.read_runs(spark, base, "project_months", monthly.schema)
    return rollups.totals(read, ["model", "run", "projectname"], count="n_rows")


@query(
    "a5_reread_for_ranking",
    sql(
        user_months_ctes(),
        """SELECT year, month_num, username, timelog FROM (SELECT *, row_number() OVER (
  PARTITION BY year, month_num ORDER BY timelog DESC, username) AS rn FROM user_months) WHERE rn = 1""",
    ),
)
def a5_reread_for_ranking(spark, folder):
    monthly = star.user_months(spark, folder)
    base = scratch_path(spark, "results")
    results.write_result(monthly, base, "history", "full", "user_months", fmt="parquet")
    again = results.read_result(spark, base, "history", "full", "user_months", monthly.schema, "parquet")
    return ranking.top_user_per_month(again).select("year", "month_num", "username", "timelog")


@query(
    "a6_projects_table",
    """SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS projectid, p_brand AS projectname
FROM part""",
)
def a6_projects_table(spark, folder):
    path = scratch_path(spark, "projects")
    timelogs.write_projects(star.parts(spark, folder).select("projectid", "projectname").distinct(), path)
    return timelogs.read_projects(spark, path)


# ---- B: filters and guards ------------------------------------------------------------


@query(
    "b1_year_range",
    sql(
        [user_logs_cte(1997, 2001)],
        """SELECT year, count(*) AS n_rows, CAST(sum(timelog) AS BIGINT) AS timelog
FROM user_logs GROUP BY year""",
    ),
)
def b1_year_range(spark, folder):
    logs = filters.year_between(star.line_logs(spark, folder), 1997, 2001)
    users = joins.rollup_by_lookup(logs, star.suppliers(spark, folder), "suppkey", "username", by=["year"], count="n_rows")
    return rollups.totals(users, ["year"], count="n_rows")


@query(
    "b2_train_test_split",
    sql(
        user_months_ctes(),
        """SELECT CASE WHEN year <= 1999 THEN 'train' ELSE 'test' END AS part, username, count(*) AS n_rows,
  CAST(sum(timelog) AS BIGINT) AS timelog
FROM user_months WHERE year <= 2000 GROUP BY 1, 2""",
    ),
)
def b2_train_test_split(spark, folder):
    train, test = filters.split_by_year(materialise(star.user_months(spark, folder)), 1999)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "username").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("timelog").alias("timelog")
    )


@query(
    "b3_single_entity",
    sql(
        project_months_ctes(),
        "SELECT projectname, year, month_num, timelog FROM project_months WHERE projectname = 'Brand#7'",
    ),
)
def b3_single_entity(spark, folder):
    return filters.one_entity(star.project_months(spark, folder), "projectname", "Brand#7")


@query(
    "b4_series_columns",
    sql(
        [full_logs_cte()],
        f"""SELECT username, strftime(make_date(year, month_num, 1), '%Y-%m-%d') AS ds,
  CAST(sum(timelog) AS BIGINT) AS y, {r4("avg(projectid)")} AS projectid
FROM full_logs GROUP BY username, year, month_num""",
    ),
)
def b4_series_columns(spark, folder):
    monthly = rollups.user_months_with_project(star.cells(spark, folder))
    return tidy(filters.as_series(monthly, "username", regressors=["projectid"]))


def _customer_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per customer; customers who never ordered leave their calendar empty."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_custkey").alias("c_custkey"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month_num"),
        F.lit(1).cast("long").alias("timelog"),
    )
    customers = spark.read.parquet(f"{folder}/customer.parquet").select(
        "c_custkey", F.col("c_name").alias("username"), F.col("c_mktsegment").alias("projectname")
    )
    return customers.join(orders, "c_custkey", "left").drop("c_custkey")


_CUSTOMER_LOGS = """customer_logs AS (SELECT c_name AS username, c_mktsegment AS projectname,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month_num,
  CASE WHEN o_orderkey IS NOT NULL THEN 1 END AS timelog
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey)"""


@query(
    "b5_drop_null_keys",
    sql(
        [_CUSTOMER_LOGS],
        """SELECT projectname, count(*) AS n_rows, count(DISTINCT username) AS n_users FROM customer_logs
WHERE year IS NOT NULL AND month_num IS NOT NULL GROUP BY projectname""",
    ),
)
def b5_drop_null_keys(spark, folder):
    kept = filters.drop_null_keys(_customer_logs(spark, folder), ["year", "month_num"])
    return kept.groupBy("projectname").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("username").alias("n_users")
    )


@query(
    "b6_null_audit",
    sql(
        [_CUSTOMER_LOGS],
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM customer_logs"
            for c in ["username", "projectname", "year", "month_num", "timelog"]
        ),
    ),
)
def b6_null_audit(spark, folder):
    return quality.null_audit(_customer_logs(spark, folder))


@query("b7_distinct_users", sql([user_logs_cte()], "SELECT DISTINCT username FROM user_logs"))
def b7_distinct_users(spark, folder):
    return rollups.distinct_entities(star.active_users(spark, folder), "username")


@query(
    "b8_positive_rows",
    sql(
        [project_logs_cte()],
        """SELECT projectname, count(*) AS n_rows, CAST(sum(timelog - 10) AS BIGINT) AS timelog
FROM project_logs WHERE timelog - 10 > 0 GROUP BY projectname""",
    ),
)
def b8_positive_rows(spark, folder):
    net = filters.positive_only(star.line_logs(spark, folder).withColumn("timelog", F.col("timelog") - 10))
    return joins.rollup_by_lookup(net, star.parts(spark, folder), "partkey", "projectname", by=(), count="n_rows")


@query(
    "b13_number_or_zero",
    """SELECT o_orderpriority, count(*) AS n_rows,
  sum(coalesce(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE), 0)) AS digits,
  sum(coalesce(try_cast(o_orderpriority AS DOUBLE), 0)) AS texts,
  sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END) + 0.0::DOUBLE AS not_nan
FROM orders GROUP BY o_orderpriority""",
)
def b13_number_or_zero(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    nan_when_open = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(1.0)
    return orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(num.parse_or_zero(F.substring("o_orderpriority", 1, 1))).alias("digits"),
        F.sum(num.parse_or_zero(F.col("o_orderpriority"))).alias("texts"),
        F.sum(num.number_or_zero(nan_when_open)).alias("not_nan"),
    )


@query(
    "b14_constant_year",
    sql(
        [project_logs_cte()],
        """SELECT projectname, CAST(sum(timelog) AS BIGINT) AS timelog, CAST(2001 AS INTEGER) AS year
FROM project_logs GROUP BY projectname""",
    ),
)
def b14_constant_year(spark, folder):
    return filters.with_year(star.project_totals(spark, folder), 2001)


_NAMED_MONTHS = f"""named AS (SELECT l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN upper({month_name_sql("month(l_shipdate)")})
  ELSE {month_name_sql("month(l_shipdate)")} END AS month FROM lineitem)"""


@query(
    "b15_calendar_violations",
    sql(
        [_NAMED_MONTHS],
        f"""SELECT year, month, reason, count(*) AS n_rows FROM (SELECT *, CASE WHEN month IS NULL
  THEN 'month missing' WHEN NOT list_contains({MONTH_LIST}, month) THEN 'month unknown' END AS reason FROM named)
WHERE reason IS NOT NULL GROUP BY year, month, reason""",
    ),
)
def b15_calendar_violations(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    name = cal.month_name(F.month("l_shipdate"))
    month = F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_returnflag") == "R", F.upper(name))
    named = lines.select(F.year("l_shipdate").alias("year"), month.otherwise(name).alias("month"))
    return (
        quality.calendar_violations(named)
        .groupBy("year", "month", "reason")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


# ---- C: joins -------------------------------------------------------------------------


@query(
    "c1_join_rollups",
    sql(
        [
            full_logs_cte(),
            rollup_cte("hours", "full_logs", "username"),
            """means AS (SELECT username, year, month_num, avg(projectid) AS projectid
  FROM full_logs GROUP BY username, year, month_num)""",
        ],
        f"""SELECT username, year, month_num, timelog, {r4("projectid")} AS projectid
FROM hours JOIN means USING (username, year, month_num)""",
    ),
)
def c1_join_rollups(spark, folder):
    keys, cells = ["username", "year", "month_num"], materialise(star.cells(spark, folder))
    means = rollups.user_months_with_project(cells).select(*keys, "projectid")
    return tidy(joins.join_rollups(rollups.monthly_rollup(cells, "username"), means, keys))


@query(
    "c2_project_lookup",
    sql(
        [project_logs_cte()],
        """SELECT projectid, projectname, count(*) AS n_rows, CAST(sum(timelog) AS BIGINT) AS timelog
FROM project_logs GROUP BY projectid, projectname""",
    ),
)
def c2_project_lookup(spark, folder):
    names = ["projectid", "projectname"]
    return joins.rollup_by_lookup(
        star.line_logs(spark, folder), star.parts(spark, folder), "partkey", names, by=(), count="n_rows"
    )


@query(
    "c2_lookup_unmatched",
    """SELECT coalesce(p_brand, '(unmatched)') AS projectname, count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS timelog
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON l_partkey = p_partkey GROUP BY 1""",
)
def c2_lookup_unmatched(spark, folder):
    """A dimension that lacks a third of the keys: their rows are kept under a name of their own."""
    lacking = star.parts(spark, folder).filter("partkey % 3 <> 0")
    return joins.rollup_by_lookup(
        star.line_logs(spark, folder), lacking, "partkey", "projectname", by=(), count="n_rows"
    )


@query(
    "c3_fill_months",
    sql(
        [*user_months_ctes(), *grid_ctes("grid", "user_months", "username")],
        "SELECT username, year, month_num, CAST(timelog AS BIGINT) AS timelog, observed FROM grid",
    ),
)
def c3_fill_months(spark, folder):
    grid = grids.fill_span(star.user_months(spark, folder), "username")
    return tidy(grid, "username", "year", "month_num", "timelog", "observed")


@query(
    "c4_future_months",
    sql(
        user_months_ctes(),
        """SELECT username, CAST(h AS INTEGER) AS step,
  strftime(make_date(CAST((last_idx + h) // 12 AS INTEGER), CAST((last_idx + h) % 12 + 1 AS INTEGER), 1), '%Y-%m-%d') AS ds
FROM (SELECT username, max(year * 12 + month_num - 1) AS last_idx FROM user_months GROUP BY username)
CROSS JOIN (SELECT range AS h FROM range(1, 13))""",
    ),
)
def c4_future_months(spark, folder):
    ahead = grids.future_months(star.user_months(spark, folder), "username", 12, "last_obs")
    return tidy(ahead, "username", "step", "ds")


# ---- D: aggregations ------------------------------------------------------------------


@query("d1_user_months", sql(user_months_ctes(), "SELECT username, year, month_num, timelog FROM user_months"))
def d1_user_months(spark, folder):
    return star.user_months(spark, folder)


_HALF_LOGS = """half_logs AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS username,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_partkey % 25 AS INTEGER) END AS projectid,
  CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month_num,
  CAST(l_quantity AS BIGINT) AS timelog FROM lineitem)"""


@query(
    "d1_cells_rollup",
    sql(
        [_HALF_LOGS],
        f"""SELECT 'user' AS side, username AS name, year, month_num, CAST(sum(timelog) AS BIGINT) AS timelog,
  {r4("coalesce(avg(projectid), -1)")} AS projectid FROM half_logs WHERE username IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'project', CAST(projectid AS VARCHAR), year, month_num, CAST(sum(timelog) AS BIGINT),
  CAST(-1 AS DOUBLE) FROM half_logs WHERE projectid IS NOT NULL GROUP BY projectid, year, month_num""",
    ),
)
def d1_cells_rollup(spark, folder):
    """The cells behind a report, over logs that lack a user or a project here and there."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    logs = lines.select(
        F.when(F.col("l_linenumber") != 1, F.col("l_suppkey").cast("string")).alias("username"),
        F.when(F.col("l_linenumber") != 2, (F.col("l_partkey") % 25).cast("int")).alias("projectid"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month_num"),
        F.col("l_quantity").cast("long").alias("timelog"),
    ).withColumn("projectname", F.col("projectid").cast("string"))
    cells = rollups.log_cells(logs)
    users = rollups.user_months_with_project(cells).select(
        F.lit("user").alias("side"),
        F.col("username").alias("name"),
        "year",
        "month_num",
        "timelog",
        F.coalesce("projectid", F.lit(-1.0)).alias("projectid"),
    )
    projects = rollups.monthly_rollup(cells, "projectname").select(
        F.lit("project").alias("side"),
        F.col("projectname").alias("name"),
        "year",
        "month_num",
        "timelog",
        F.lit(-1.0).alias("projectid"),
    )
    return tidy(users.unionByName(projects))


@query(
    "d1_stream_part_months",
    sql(part_months_ctes(), "SELECT partkey, year, month_num, timelog FROM part_months"),
)
def d1_stream_part_months(spark, folder):
    """The rollup fed by a file stream over the line items."""
    schema = spark.read.parquet(f"{folder}/lineitem.parquet").schema
    lines = rollup_stream.stream_logs(spark, f"{folder}/lineitem.parquet", schema)
    out = scratch_path(spark, "stream")
    rollup_stream.run_monthly_rollup(star.as_line_logs(lines), "partkey", out)
    return rollup_stream.month_deltas(spark, "partkey", out)


@query(
    "d2_project_months",
    sql(project_months_ctes(), "SELECT projectname, year, month_num, timelog FROM project_months"),
)
def d2_project_months(spark, folder):
    return star.project_months(spark, folder)


@query(
    "d3_project_user_totals",
    sql(
        [full_logs_cte()],
        """SELECT projectname, username, CAST(sum(timelog) AS BIGINT) AS timelog
FROM full_logs GROUP BY projectname, username""",
    ),
)
def d3_project_user_totals(spark, folder):
    return rollups.totals(star.cells(spark, folder, by=()), ["projectname", "username"])


@query(
    "d4_project_totals",
    sql(
        [project_logs_cte()],
        "SELECT projectname, CAST(sum(timelog) AS BIGINT) AS timelog FROM project_logs GROUP BY projectname",
    ),
)
def d4_project_totals(spark, folder):
    return star.project_totals(spark, folder)


@query(
    "d5_user_totals",
    sql(
        [user_logs_cte()],
        "SELECT username, CAST(sum(timelog) AS BIGINT) AS timelog FROM user_logs GROUP BY username",
    ),
)
def d5_user_totals(spark, folder):
    return star.user_totals(spark, folder)


@query(
    "d6_mean_project",
    sql(
        [full_logs_cte()],
        f"""SELECT username, year, month_num, CAST(sum(timelog) AS BIGINT) AS timelog,
  {r4("avg(projectid)")} AS projectid FROM full_logs GROUP BY username, year, month_num""",
    ),
)
def d6_mean_project(spark, folder):
    return tidy(rollups.user_months_with_project(star.cells(spark, folder)))


@query(
    "d7_month_totals",
    sql(
        [project_logs_cte()],
        """SELECT year, month_num, CAST(sum(timelog) AS BIGINT) AS timelog
FROM project_logs GROUP BY year, month_num""",
    ),
)
def d7_month_totals(spark, folder):
    return rollups.monthly_total(star.project_months(spark, folder))


@query(
    "d7_month_totals_expanded",
    sql(
        [project_logs_cte()],
        """SELECT y.year, m.month_num, CAST(coalesce(sum(timelog), 0) AS BIGINT) AS timelog
FROM (SELECT DISTINCT year FROM project_logs) y
CROSS JOIN (SELECT CAST(range AS INTEGER) AS month_num FROM range(1, 13)) m
LEFT JOIN project_logs p ON p.year = y.year AND p.month_num = m.month_num GROUP BY y.year, m.month_num""",
    ),
)
def d7_month_totals_expanded(spark, folder):
    return rollups.monthly_total(star.project_months(spark, folder), expand_months=True)


@query(
    "d9_population_mean",
    sql(
        user_months_ctes(),
        f"""SELECT {r4("(SELECT avg(t) FROM (SELECT sum(timelog) AS t FROM user_months GROUP BY year, month_num))"
                       " / (SELECT count(DISTINCT username) FROM user_months)")} AS population_mean""",
    ),
)
def d9_population_mean(spark, folder):
    return tidy(rollups.population_mean(star.user_months(spark, folder), "username"))


@query(
    "d10_entity_mean",
    sql(
        user_months_ctes(),
        f"SELECT username, {r4('avg(timelog)')} AS mean_timelog FROM user_months GROUP BY username",
    ),
)
def d10_entity_mean(spark, folder):
    return tidy(rollups.mean_per_entity(star.user_months(spark, folder), "username"))


@query(
    "d11_months_present",
    sql([user_logs_cte()], f"SELECT DISTINCT {month_name_sql('month(date)')} AS month FROM user_logs"),
)
def d11_months_present(spark, folder):
    return rollups.months_present(star.line_logs(spark, folder))


@query(
    "d12_peak_month",
    sql(user_months_ctes(), "SELECT max(timelog) AS max_timelog FROM user_months"),
)
def d12_peak_month(spark, folder):
    return quality.peak_month(star.user_months(spark, folder))


@query(
    "d12_limit_violations",
    sql(user_months_ctes(), "SELECT username, year, month_num, timelog FROM user_months WHERE timelog > 160"),
)
def d12_limit_violations(spark, folder):
    return quality.limit_violations(star.user_months(spark, folder), 160)


@query(
    "d13_scaling_stats",
    sql(
        part_months_ctes(),
        "SELECT partkey, "
        + ", ".join(
            f"{r4(f'avg({c})')} AS {c}_mean, "
            + r4(f"CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END")
            + f" AS {c}_std"
            for c in ["year", "month_num", "timelog"]
        )
        + " FROM part_months GROUP BY partkey",
    ),
)
def d13_scaling_stats(spark, folder):
    monthly = rollups.monthly_rollup(star.line_logs(spark, folder), "partkey")
    return tidy(scaling.scaling_stats(monthly, "partkey", ["year", "month_num", "timelog"]))


@query(
    "d13_standardise",
    sql(
        user_months_ctes(),
        "SELECT username, year, month_num, timelog, "
        + r4("(timelog - avg(timelog) OVER w) / CASE WHEN stddev_pop(timelog) OVER w = 0 THEN 1 "
             "ELSE stddev_pop(timelog) OVER w END")
        + " AS timelog_z FROM user_months WINDOW w AS (PARTITION BY username)",
    ),
)
def d13_standardise(spark, folder):
    return tidy(scaling.standardise(star.user_months(spark, folder), "username", ["timelog"]))


@query(
    "d14_minmax_scale",
    sql(
        user_months_ctes(),
        f"""SELECT username, year, month_num, timelog, low, span, {r4("(timelog - low) / span")} AS scaled,
  timelog + 0.0::DOUBLE AS restored
FROM (SELECT *, CAST(min(timelog) OVER w AS DOUBLE) AS low,
  CAST(CASE WHEN max(timelog) OVER w = min(timelog) OVER w THEN 1
       ELSE max(timelog) OVER w - min(timelog) OVER w END AS DOUBLE) AS span
  FROM user_months WINDOW w AS (PARTITION BY username))""",
    ),
)
def d14_minmax_scale(spark, folder):
    scaled = scaling.minmax_scale(star.user_months(spark, folder), "username")
    restored = scaling.inverse_minmax(F.col("scaled"), F.col("low"), F.col("span"))
    return tidy(scaled.withColumn("restored", restored))


@query(
    "d15_rows_per_user",
    sql(user_months_ctes(), "SELECT username, count(*) AS n_rows FROM user_months GROUP BY username"),
)
def d15_rows_per_user(spark, folder):
    return rollups.rows_per_entity(star.user_months(spark, folder), "username")


@query("d16_count_users", sql([user_logs_cte()], "SELECT count(DISTINCT username) AS n_entities FROM user_logs"))
def d16_count_users(spark, folder):
    return rollups.count_entities(star.active_users(spark, folder), "username")


# ---- E: ranks and windows -------------------------------------------------------------


def _ranked_sql(source: str, partition: str, order: str, columns: str, k: int = 1) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {partition}
  ORDER BY timelog DESC, {order}) AS rn FROM {source}) WHERE rn <= {k}"""


@query(
    "e1_top_user_per_month",
    sql(
        user_months_ctes(),
        _ranked_sql("user_months", "year, month_num", "username", "year, month_num, username, timelog"),
    ),
)
def e1_top_user_per_month(spark, folder):
    return ranking.top_user_per_month(star.user_months(spark, folder))


_PROJECT_USERS = [
    full_logs_cte(),
    """project_users AS (SELECT projectname, username, CAST(sum(timelog) AS BIGINT) AS timelog
  FROM full_logs GROUP BY projectname, username)""",
]


@query(
    "e2_top_user_per_project",
    sql(
        _PROJECT_USERS,
        _ranked_sql("project_users", "projectname", "username", "projectname, username, timelog"),
    ),
)
def e2_top_user_per_project(spark, folder):
    return ranking.top_user_per_project(
        rollups.totals(star.cells(spark, folder, by=()), ["projectname", "username"])
    )


@query(
    "e5_top3_users_per_month",
    sql(
        user_months_ctes(),
        _ranked_sql("user_months", "year, month_num", "username", "year, month_num, username, timelog", 3),
    ),
)
def e5_top3_users_per_month(spark, folder):
    return ranking.top_k(star.user_months(spark, folder), ["year", "month_num"], "timelog", ["username"], 3)


@query(
    "e6_lag_windows",
    sql(
        [*user_months_ctes(), *grid_ctes("grid", "user_months", "username")],
        """SELECT t.username, t.month_idx, CAST(t.timelog AS BIGINT) AS target,
  CAST(12 - (t.month_idx - l.month_idx) AS INTEGER) AS pos, CAST(l.timelog AS BIGINT) AS lag
FROM grid t JOIN grid l ON l.username = t.username
  AND l.month_idx BETWEEN t.month_idx - 12 AND t.month_idx - 1
WHERE t.month_idx >= (SELECT min(year) FROM user_months) * 12 + 12""",
    ),
)
def e6_lag_windows(spark, folder):
    grid = grids.fill_span(star.user_months(spark, folder), "username")
    framed = windows.lag_windows(grid.select("username", "month_idx", "timelog"), "username", "timelog")
    return framed.select("username", "month_idx", "target", F.posexplode("lags").alias("pos", "lag"))


@query(
    "e7_last_context",
    sql(
        user_months_ctes(),
        """SELECT username, CAST(12 - rn AS INTEGER) AS pos, timelog AS value FROM (SELECT *, row_number() OVER (
  PARTITION BY username ORDER BY year DESC, month_num DESC) AS rn,
  count(*) OVER (PARTITION BY username) AS n FROM user_months) WHERE rn <= 12 AND n >= 12""",
    ),
)
def e7_last_context(spark, folder):
    monthly = star.user_months(spark, folder).withColumn(
        "month_idx", cal.month_index(F.col("year"), F.col("month_num"))
    )
    last = windows.last_context(monthly, "username", "timelog")
    return last.select("username", F.posexplode("context").alias("pos", "value"))


# ---- F: sorts and limits --------------------------------------------------------------


@query(
    "f1_calendar_order",
    sql(project_months_ctes(), "SELECT year, month_num, projectname, timelog FROM project_months ORDER BY 1, 2, 3"),
)
def f1_calendar_order(spark, folder):
    monthly = star.project_months(spark, folder).select("year", "month_num", "projectname", "timelog")
    return ranking.in_calendar_order(monthly, "projectname")


@query(
    "f2_month_order",
    sql(
        [project_logs_cte()],
        f"""SELECT month_num, {month_name_sql("month_num")} AS month, CAST(sum(timelog) AS BIGINT) AS timelog
FROM project_logs GROUP BY month_num ORDER BY month_num""",
    ),
)
def f2_month_order(spark, folder):
    totals = rollups.totals(star.project_months(spark, folder), ["month_num"])
    return totals.select("month_num", cal.month_name(F.col("month_num")).alias("month"), "timelog").orderBy(
        "month_num"
    )


@query(
    "f3_time_order_in_entity",
    sql(
        user_months_ctes(),
        """SELECT username, year, month_num, timelog, CAST(row_number() OVER (
  PARTITION BY username ORDER BY year, month_num) AS INTEGER) AS position FROM user_months""",
    ),
)
def f3_time_order_in_entity(spark, folder):
    order = Window.partitionBy("username").orderBy("year", "month_num")
    return star.user_months(spark, folder).withColumn("position", F.row_number().over(order))


@query(
    "f4_preview",
    sql(
        user_months_ctes(),
        "SELECT username, year, month_num, timelog FROM user_months ORDER BY username, year, month_num LIMIT 10",
    ),
)
def f4_preview(spark, folder):
    return filters.preview(star.user_months(spark, folder), ["username", "year", "month_num"], 10)


# ---- H: scalar functions --------------------------------------------------------------


@query(
    "h1_month_number",
    """SELECT strftime(l_shipdate, '%b') AS month, CAST(month(l_shipdate) AS INTEGER) AS month_num,
  count(*) AS n_rows FROM lineitem GROUP BY 1, 2""",
)
def h1_month_number(spark, folder):
    named = star.line_logs(spark, folder).select(cal.month_name_of(F.col("date")).alias("month"))
    return (
        named.withColumn("month_num", cal.month_number(F.col("month")))
        .groupBy("month", "month_num")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


# The long month names that the input may hold, whatever the locale.
_LONG_NAMES = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)


@query(
    "h2_long_month_number",
    """SELECT monthname(l_shipdate) AS month, CAST(month(l_shipdate) AS INTEGER) AS month_num,
  count(*) AS n_rows FROM lineitem GROUP BY 1, 2""",
)
def h2_long_month_number(spark, folder):
    named = star.line_logs(spark, folder).select(
        F.element_at(F.array(*[F.lit(n) for n in _LONG_NAMES]), F.month("date")).alias("month")
    )
    return cal.normalise_month(named).groupBy("month", "month_num").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "h3_month_name",
    """SELECT CAST(month(o_orderdate) AS INTEGER) AS month_num, strftime(o_orderdate, '%b') AS month,
  count(*) AS n_rows FROM orders GROUP BY 1, 2""",
)
def h3_month_name(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    named = orders.select(F.month("o_orderdate").alias("month_num")).withColumn(
        "month", cal.month_name(F.col("month_num"))
    )
    return named.groupBy("month_num", "month").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "h4_h5_date_parts",
    """SELECT strftime(o_orderdate, '%b') AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
  count(*) AS n_rows FROM orders GROUP BY 1, 2""",
)
def h4_h5_date_parts(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("ds"))
    return (
        orders.select(cal.month_name_of(F.col("ds")).alias("month"), F.year("ds").alias("year"))
        .groupBy("month", "year")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "h6_month_start",
    """SELECT CASE WHEN m <= 12 THEN strftime(make_date(y, CASE WHEN m <= 12 THEN m ELSE 1 END, 1), '%Y-%m-%d') END
  AS ds, count(*) AS n_rows
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) + l_linenumber AS INTEGER) AS m
  FROM lineitem) GROUP BY 1""",
)
def h6_month_start(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    shifted = F.month("l_shipdate") + F.col("l_linenumber")  # passes 12, where there is no such date
    starts = lines.select(cal.month_start(F.year("l_shipdate"), shifted).alias("ds"))
    return tidy(starts.groupBy("ds").agg(F.count(F.lit(1)).alias("n_rows")))


@query(
    "h7_date_text",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date_text, count(*) AS n_rows FROM orders GROUP BY 1",
)
def h7_date_text(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    text = cal.date_text(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return orders.select(text.alias("date_text")).groupBy("date_text").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "h8_cyclic_month",
    sql(
        project_months_ctes(),
        f"""SELECT projectname, year, month_num, timelog, {r4("sin(2 * pi() * month_num / 12)")} AS month_sin,
  {r4("cos(2 * pi() * month_num / 12)")} AS month_cos FROM project_months""",
    ),
)
def h8_cyclic_month(spark, folder):
    return tidy(cal.add_cyclic_month(star.project_months(spark, folder)))


@query(
    "h9_h10_years_and_growth",
    sql(
        user_months_ctes(),
        f"""SELECT username, year, month_num, CAST(year - 1995 AS INTEGER) AS years_since_start,
  {r4("timelog * 1.05::DOUBLE")} AS grown FROM user_months""",
    ),
)
def h9_h10_years_and_growth(spark, folder):
    return tidy(
        star.user_months(spark, folder).select(
            "username",
            "year",
            "month_num",
            num.years_since(F.col("year"), FIRST_YEAR).alias("years_since_start"),
            (F.col("timelog") * num.growth_factor(2001, 2000)).alias("grown"),
        )
    )


@query(
    "h11_round_half_even",
    f"""SELECT l_linenumber, sum(round_even(l_quantity / 2, 0)) AS halves,
  {r4("sum(round_even(l_quantity / 20, 1))")} AS tenths FROM lineitem GROUP BY l_linenumber""",
)
def h11_round_half_even(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return tidy(
        lines.groupBy("l_linenumber").agg(
            F.sum(num.round_half_even(F.col("l_quantity") / 2)).alias("halves"),
            F.sum(num.round_half_even(F.col("l_quantity") / 20, 1)).alias("tenths"),
        )
    )


@query(
    "h12_month_sequence",
    """SELECT c_name AS username, strftime(date_trunc('month', first_date) + to_months(CAST(i AS INTEGER)), '%Y-%m-%d') AS ds
FROM (SELECT c_name, min(o_orderdate) AS first_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name)
CROSS JOIN (SELECT range AS i FROM range(0, 12))""",
)
def h12_month_sequence(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderdate").cast("date").alias("date")
    )
    customers = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("username")
    )
    first = joins.lookup(orders.groupBy("custkey").agg(F.min("date").alias("date")), customers, "custkey")
    return tidy(first.select("username", F.explode(cal.month_sequence(F.col("date"), 12)).alias("ds")))


@query(
    "h13_casts",
    """SELECT CAST(p_size AS VARCHAR) AS size_text, count(*) AS n_rows,
  CAST(sum(coalesce(try_cast(p_brand AS DOUBLE), 0)) AS DOUBLE) AS brand_numbers,
  CAST(sum(try_cast(CAST(p_size AS VARCHAR) AS INTEGER)) AS BIGINT) AS size_sum FROM part GROUP BY p_size""",
)
def h13_casts(spark, folder):
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return (
        parts.withColumn("size_text", F.col("p_size").cast("string"))
        .groupBy("size_text")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(num.parse_or_zero(F.col("p_brand"))).alias("brand_numbers"),
            F.sum(F.col("size_text").try_cast("int")).alias("size_sum"),
        )
    )


@query(
    "k1_element_functions",
    sql(
        [user_logs_cte()],
        f"""SELECT username, {month_name_sql("month_num")} AS month, month_num, count(*) AS n_rows
FROM user_logs GROUP BY username, month_num""",
    ),
)
def k1_element_functions(spark, folder):
    """Name from number and number from name, both as built-in expressions."""
    counted = joins.rollup_by_lookup(
        star.line_logs(spark, folder), star.suppliers(spark, folder), "suppkey", "username", by=["month_num"], count="n_rows"
    )
    named = counted.select("username", cal.month_name(F.col("month_num")).alias("month"), "n_rows")
    return named.select("username", "month", cal.month_number(F.col("month")).alias("month_num"), "n_rows")


# ---- M: apportionment, scaffolds, classes ---------------------------------------------


@query(
    "m1_apportion",
    sql(
        [
            *user_months_ctes(),
            """parts AS (SELECT year, month_num, username, timelog,
  CAST(round_even(CAST(10000 AS DOUBLE) * timelog / CAST(sum(timelog) OVER w AS DOUBLE), 0) AS BIGINT) AS part,
  row_number() OVER (PARTITION BY year, month_num ORDER BY username) AS rn
  FROM user_months WINDOW w AS (PARTITION BY year, month_num))""",
        ],
        """SELECT year, month_num, username, timelog, CAST(part + CASE WHEN rn = 1
  THEN 10000 - sum(part) OVER (PARTITION BY year, month_num) ELSE 0 END AS BIGINT) AS share FROM parts""",
    ),
)
def m1_apportion(spark, folder):
    monthly = star.user_months(spark, folder)
    shared = app.apportion(monthly, ["year", "month_num"], "username", F.lit(10000), "timelog")
    return shared.select("year", "month_num", "username", "timelog", "share")


@query(
    "m2_day_scaffold",
    sql(
        [
            user_logs_cte(),
            "logged AS (SELECT username, date, CAST(sum(timelog) AS BIGINT) AS timelog FROM user_logs GROUP BY username, date)",
            """days AS (SELECT username, CAST(d AS DATE) AS date FROM (SELECT DISTINCT username FROM user_logs)
  CROSS JOIN (SELECT unnest(generate_series(make_date(min(year), 1, 1), make_date(max(year), 12, 31), INTERVAL 1 DAY)) AS d FROM user_logs))""",
        ],
        """SELECT username, CAST(year(d.date) AS INTEGER) AS year, CAST(month(d.date) AS INTEGER) AS month_num,
  count(*) AS n_days, count(timelog) AS n_logged, CAST(coalesce(sum(timelog), 0) AS BIGINT) AS timelog
FROM days d LEFT JOIN logged l USING (username, date) GROUP BY ALL""",
    ),
)
def m2_day_scaffold(spark, folder):
    """Calendar days per user and month, and on how many of them something was logged."""
    logged = joins.rollup_by_lookup(
        star.line_logs(spark, folder), star.suppliers(spark, folder), "suppkey", "username", by=["date"]
    )
    logged = materialise(logged, "user-days")
    days = grids.day_scaffold(logged, "username")
    joined = days.join(logged, ["username", "date"], "left")
    return joined.groupBy("username", F.year("date").alias("year"), F.month("date").alias("month_num")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("timelog").alias("n_logged"),
        F.coalesce(F.sum("timelog"), F.lit(0)).alias("timelog"),
    )


@query(
    "m3_activity_class",
    sql(
        [*user_months_ctes(), *grid_ctes("grid", "user_months", "username")],
        """SELECT username, year, month_num, CAST(timelog AS BIGINT) AS timelog, CASE WHEN timelog >= 160
  THEN 'full_time' WHEN timelog > 0 THEN 'part_time' ELSE 'no_log' END AS activity FROM grid""",
    ),
)
def m3_activity_class(spark, folder):
    grid = grids.fill_span(star.user_months(spark, folder), "username")
    return app.activity_class(grid).select("username", "year", "month_num", "timelog", "activity")
