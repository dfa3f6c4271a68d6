from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallycast import functions as fn
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_month_names_and_numbers_invert_each_other(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    back = df.withColumn("name", fn.month_name(F.col("m"))).withColumn("n", fn.month_number(F.col("name")))
    assert [r.name for r in back.orderBy("m").collect()] == list(fn.MONTHS)
    assert all(r.m == r.n for r in back.collect())


@pytest.mark.parametrize("bad", ["Foo", "January", "jan", None])
def test_strict_month_number_fails(spark, bad):
    with pytest.raises(Exception, match="not a month name"):
        one(spark, fn.month_number(F.lit(bad).cast("string")))


def test_truncated_month_number(spark):
    assert one(spark, fn.month_number(F.lit("January"), truncate=True)) == 1
    assert one(spark, fn.try_month_number(F.lit("Fooember"), truncate=True)) is None


@pytest.mark.parametrize("value", ["Sep", "September", "9", "09", " 9 ", 9])
def test_normalise_month_takes_names_and_numbers(spark, value):
    df = spark.range(1).select(F.lit(value).alias("month"))
    assert fn.normalise_month(df).first()["month_num"] == 9


@pytest.mark.parametrize("value", [0, 13, "0", "13", "-1", "Foo", ""])
def test_normalise_month_rejects_other_numbers(spark, value):
    df = spark.range(1).select(F.lit(value).alias("month"))
    with pytest.raises(Exception, match="not a month number or name"):
        fn.normalise_month(df).collect()


def test_month_start_is_null_for_impossible_dates(spark):
    df = spark.createDataFrame([(2020, 2), (2020, 13), (2020, 0), (None, 3), (2020, None)], "y int, m int")
    got = [r.d for r in df.select(fn.month_start(F.col("y"), F.col("m")).alias("d")).collect()]
    assert got == [dt.date(2020, 2, 1), None, None, None, None]


def test_month_index_round_trip(spark):
    df = spark.range(23900, 24100).select(F.col("id").cast("int").alias("i"))
    back = df.select("i", fn.index_to_date(F.col("i")).alias("d")).select(
        "i", fn.month_index(F.year("d"), F.month("d")).alias("j")
    )
    assert back.filter("i != j").count() == 0


def test_month_sequence_crosses_the_year(spark):
    got = one(spark, fn.month_sequence(F.lit("2024-11-17").cast("date"), 3))
    assert got == [dt.date(2024, 11, 1), dt.date(2024, 12, 1), dt.date(2025, 1, 1)]


def test_date_text_pads(spark):
    assert one(spark, fn.date_text(F.lit(2016), F.lit(1), F.lit(9))) == "2016-01-09"


def test_cyclic_month_values_and_missing_column(spark):
    df = spark.createDataFrame([(3,), (12,)], "month_num int")
    got = fn.add_cyclic_month(df).orderBy("month_num").collect()
    assert math.isclose(got[0].month_sin, 1.0) and math.isclose(got[1].month_cos, 1.0)
    with pytest.raises(KeyError):
        fn.add_cyclic_month(df.withColumnRenamed("month_num", "m"))


def test_clamp_and_coercion(spark):
    df = spark.createDataFrame([(float("nan"),), (-2.0,), (3.0,), (None,)], "v double")
    assert [r[0] for r in df.select(fn.clamp_zero(F.col("v"))).collect()] == [0.0, 0.0, 3.0, 0.0]
    inf = spark.createDataFrame([(float("inf"),), (float("-inf"),), (2.5,)], "v double")
    assert [r[0] for r in inf.select(fn.finite_or_zero(F.col("v"))).collect()] == [0.0, 0.0, 2.5]
    assert [r[0] for r in df.select(fn.number_or_zero(F.col("v"))).collect()] == [0.0, -2.0, 3.0, 0.0]
    cells = ["1.5", "x", None, "NaN", " -2 ", "1e3", ".5", "5.", "1,000", "", "12abc", "1e", "+7"]
    text = spark.createDataFrame([(c,) for c in cells], "v string")
    got = [r[0] for r in text.select(fn.parse_or_zero(F.col("v"))).collect()]
    assert got == [1.5, 0.0, 0.0, 0.0, -2.0, 1000.0, 0.5, 5.0, 0.0, 0.0, 0.0, 0.0, 7.0]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    assert rows(df.select(fn.round_half_even(F.col("v")))) == [(-0.0,), (0.0,), (2.0,), (2.0,)]


def test_growth_factor(spark):
    assert math.isclose(one(spark, fn.growth_factor(2025, 2024)), 1.05)
    assert one(spark, fn.years_since(F.lit(2025), 2020)) == 5
