"""Canonical logs out of a star schema (line items with supplier and part).

The supplier is the user, the part's brand is the project, the shipped quantity
is the time logged. Only the columns an analysis needs are joined: user reports
never touch the part table and project reports never touch the supplier table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.operators.joins import lookup, rollup_by_lookup
from tallycast.operators.rollups import totals

# The columns used, stated so that no job runs to look into file footers.
_COLUMNS = {
    "lineitem": "l_suppkey bigint, l_partkey bigint, l_quantity double, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string",
    "part": "p_partkey bigint, p_brand string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "supplier").selectExpr("s_suppkey AS suppkey", "s_name AS username")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").selectExpr(
        "p_partkey AS partkey",
        "CAST(substring_index(p_brand, '#', -1) AS INT) AS projectid",
        "p_brand AS projectname",
    )


def line_logs(
    spark: SparkSession,
    folder: str,
    first_year: int | None = None,
    last_year: int | None = None,
    whole_hours: bool = True,
) -> DataFrame:
    """Logs keyed by supplier and part number, before any name lookup.

    The year range is applied to the stored timestamp, so it reaches the scan.
    """
    lines = _table(spark, folder, "lineitem")
    if first_year is not None:
        lines = lines.filter(f"l_shipdate >= TIMESTAMP_NTZ'{first_year}-01-01'")
    if last_year is not None:
        lines = lines.filter(f"l_shipdate < TIMESTAMP_NTZ'{last_year + 1}-01-01'")
    return as_line_logs(lines, whole_hours)


# Whole hours are exact as integers; a fraction fails the query instead of being cut off.
_WHOLE = """CASE WHEN l_quantity IS NULL OR l_quantity = floor(l_quantity) THEN CAST(l_quantity AS BIGINT)
    ELSE raise_error(concat('l_quantity is no whole number: ', l_quantity)) END"""


def as_line_logs(lines: DataFrame, whole_hours: bool = True) -> DataFrame:
    """Line items as logs. With ``whole_hours=False`` fractions are kept, and ``timelog`` is a double."""
    return lines.selectExpr(
        "l_suppkey AS suppkey",
        "l_partkey AS partkey",
        "CAST(l_shipdate AS DATE) AS date",
        "year(l_shipdate) AS year",
        "month(l_shipdate) AS month_num",
        f"{_WHOLE if whole_hours else 'l_quantity'} AS timelog",
    )


def user_logs(spark: SparkSession, folder: str, first_year=None, last_year=None) -> DataFrame:
    return lookup(line_logs(spark, folder, first_year, last_year), suppliers(spark, folder), "suppkey")


def project_logs(spark: SparkSession, folder: str, first_year=None, last_year=None) -> DataFrame:
    return lookup(line_logs(spark, folder, first_year, last_year), parts(spark, folder), "partkey")


def full_logs(spark: SparkSession, folder: str, first_year=None, last_year=None) -> DataFrame:
    """Logs with both the user and the project looked up."""
    return lookup(user_logs(spark, folder, first_year, last_year), parts(spark, folder), "partkey")


def cells(
    spark: SparkSession, folder: str, first_year=None, last_year=None, by: Sequence[str] = ("year", "month_num")
) -> DataFrame:
    """(username, projectid, projectname, by, timelog, n_rows): sums over user, project and month.

    Single log rows are summed before any lookup and again after the first one, so neither
    join moves them.
    """
    lines = line_logs(spark, folder, first_year, last_year)
    by_part = totals(lines, ["suppkey", "partkey", *by], count="n_rows")
    project = ["projectid", "projectname"]
    named = lookup(by_part, parts(spark, folder), "partkey").groupBy("suppkey", *project, *by)
    named = named.agg(F.sum("timelog").alias("timelog"), F.sum("n_rows").alias("n_rows"))
    both = lookup(named, suppliers(spark, folder), "suppkey").groupBy("username", *project, *by)
    return both.agg(F.sum("timelog").alias("timelog"), F.sum("n_rows").alias("n_rows"))


def user_months(spark: SparkSession, folder: str, first_year=None, last_year=None) -> DataFrame:
    """Monthly hours per user: (username, year, month_num, timelog)."""
    return rollup_by_lookup(
        line_logs(spark, folder, first_year, last_year), suppliers(spark, folder), "suppkey", "username"
    )


def project_months(spark: SparkSession, folder: str, first_year=None, last_year=None) -> DataFrame:
    """Monthly hours per project: (projectname, year, month_num, timelog)."""
    return rollup_by_lookup(
        line_logs(spark, folder, first_year, last_year), parts(spark, folder), "partkey", "projectname"
    )


def user_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(username, timelog) over the whole log."""
    return rollup_by_lookup(line_logs(spark, folder), suppliers(spark, folder), "suppkey", "username", by=())


def project_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(projectname, timelog) over the whole log."""
    return rollup_by_lookup(line_logs(spark, folder), parts(spark, folder), "partkey", "projectname", by=())


def active_users(spark: SparkSession, folder: str) -> DataFrame:
    """(username), once per supplier that occurs in the log: keys are made distinct before the lookup."""
    keys = line_logs(spark, folder).select("suppkey").distinct()
    return lookup(keys, suppliers(spark, folder), "suppkey")
