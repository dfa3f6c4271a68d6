"""Joins: name lookups, rollup joins, aligned series, and group totals put back on rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.operators.rollups import totals


# Stands for the name of a key that the dimension does not have.
UNMATCHED = "(unmatched)"


def lookup(logs: DataFrame, dimension: DataFrame, key: str, unmatched: str | None = UNMATCHED) -> DataFrame:
    """Attach the dimension's columns by key.

    Rows whose key the dimension lacks (or that have none) stay: their text columns read
    ``unmatched``, the other ones are null. With ``unmatched=None`` such rows are left out.
    No hint is given: the planner broadcasts a dimension below the size
    threshold, and beyond it runs a shuffled join whose hot keys adaptive
    execution splits.
    """
    if unmatched is None:
        return logs.join(dimension, key, "inner").drop(key)
    found = "_found"
    names = [f.name for f in dimension.schema.fields if f.name != key and isinstance(f.dataType, T.StringType)]
    joined = logs.join(dimension.withColumn(found, F.lit(True)), key, "left")
    named = {n: F.when(F.col(found).isNull(), F.lit(unmatched)).otherwise(F.col(n)) for n in names}
    return joined.withColumns(named).drop(key, found)


def rollup_by_lookup(
    logs: DataFrame,
    dimension: DataFrame,
    key: str,
    name: str | Sequence[str],
    value: str = "timelog",
    by: Sequence[str] = ("year", "month_num"),
    count: str | None = None,
    unmatched: str | None = UNMATCHED,
) -> DataFrame:
    """Sum per looked-up name(s) and month, or per other columns in ``by`` (none: plain totals).

    The logs are summed per key first: the partial sums run before any shuffle, so a key
    holding a third of all rows arrives as one row per task and month, and the lookup
    only moves summed rows, whatever the dimension's size. Names shared by several keys are
    summed once more. ``count`` names a further column for the number of log rows.
    """
    names = [name] if isinstance(name, str) else list(name)
    per_key = totals(logs, [key, *by], value, count)
    return totals(lookup(per_key, dimension.select(key, *names), key, unmatched), [*names, *by], value, count)


def join_rollups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two rollups on their shared keys.

    Two measures of one log need no join: ask ``monthly_rollup`` for both.
    """
    return left.join(right, list(keys), "inner")


def align(
    predicted: DataFrame,
    actual: DataFrame,
    keys: Sequence[str],
    predicted_col: str = "yhat",
    actual_col: str = "timelog",
) -> DataFrame:
    """Predicted beside actual: (keys, predicted, actual), full outer on the keys."""
    left = predicted.select(*keys, F.col(predicted_col).cast("double").alias("predicted"))
    right = actual.select(*keys, F.col(actual_col).cast("double").alias("actual"))
    return left.join(right, list(keys), "full_outer")


def with_group_totals(
    df: DataFrame, keys: Sequence[str], totals: Sequence[Column], spread: Sequence[str], salts: int | None = None
) -> DataFrame:
    """Every row with its group's aggregates, without gathering a group in one task.

    The totals come from a partially combined ``groupBy``. They are joined back
    under a salt taken from the ``spread`` columns, so a group holding a third
    of all rows is spread over ``salts`` partitions (as many as a shuffle has, if not
    given); each total is repeated ``salts`` times to meet it. Null keys form a group of
    their own.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = df.groupBy(*keys).agg(*totals)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return null_safe_left_join(rows, salted, [*keys, "_salt"]).drop("_salt")


def null_safe_left_join(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where a null key matches a null key; ``other``'s further columns are added."""
    renamed = other.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return rows.join(renamed, condition, "left").drop(*[f"_right_{k}" for k in keys])
