"""Month and date expressions. All are built-in column expressions, no Python UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The month names of every input and output table, in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _names() -> Column:
    return F.array(*[F.lit(m) for m in MONTHS])


def try_month_number(name: Column, truncate: bool = False) -> Column:
    """1..12 for a month name, null for anything else."""
    text = F.substring(name, 1, 3) if truncate else name
    position = F.array_position(_names(), text)
    return F.when(position > 0, position.cast("int"))


def month_number(name: Column, truncate: bool = False) -> Column:
    """1..12 for a month name; a null or unknown name fails the query.

    ``truncate`` looks at the first three letters only, so 'January' is accepted.
    """
    complaint = F.concat(F.lit("not a month name: "), F.coalesce(name, F.lit("null")))
    return F.coalesce(try_month_number(name, truncate), F.raise_error(complaint).cast("int"))


def month_name(number: Column) -> Column:
    """'Jan'..'Dec' for 1..12, null for null; any other number fails under ANSI mode.

    The test for null is spelled out: the planner takes an element of an array without
    nulls for never null, even at a null position, and would fold later null tests away.
    """
    return F.when(number.isNotNull(), F.element_at(_names(), number.cast("int")))


def month_name_of(date: Column) -> Column:
    """'Jan'..'Dec' of a date, whatever the locale."""
    return month_name(F.month(date))


def normalise_month(df: DataFrame, col: str = "month", out: str = "month_num") -> DataFrame:
    """Add an integer month next to a month column held as number or as name.

    Text is looked up among names and numerals. A cast that may fail is avoided:
    the engine signals each failure by an exception, which costs microseconds
    per row of names.
    """
    if isinstance(df.schema[col].dataType, T.StringType):
        numerals = F.array(*[F.lit(str(n)) for n in range(1, 13)])
        position = F.array_position(numerals, F.ltrim(F.trim(F.col(col)), F.lit("0")))
        number = F.coalesce(
            try_month_number(F.col(col), truncate=True), F.when(position > 0, position.cast("int"))
        )
    else:
        number = F.when(F.col(col).between(1, 12), F.col(col).cast("int"))
    complaint = F.concat(F.lit("not a month number or name: "), F.col(col).cast("string"))
    failure = F.when(F.col(col).isNotNull(), F.raise_error(complaint).cast("int"))
    return df.withColumn(out, F.coalesce(number, failure))


def month_start(year: Column, month_num: Column) -> Column:
    """First day of the month; null when year or month is missing or out of range."""
    valid = month_num.between(1, 12) & year.between(1, 9999)
    return F.make_date(F.when(valid, year.cast("int")), F.when(valid, month_num.cast("int")), F.lit(1))


def date_text(year: Column, month_num: Column, day: Column) -> Column:
    """'2016-01-09': zero-padded date text, null when a part is null."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month_num.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month_num.isNotNull() & day.isNotNull(), text)


def month_index(year: Column, month_num: Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return (year * 12 + month_num - 1).cast("int")


def index_to_date(index: Column) -> Column:
    """Inverse of ``month_index``: the first of that month."""
    return F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))


def month_sequence(first: Column, periods: int) -> Column:
    """Array of ``periods`` month starts beginning with ``first``."""
    start = F.trunc(first, "month")
    return F.sequence(start, F.add_months(start, periods - 1), F.expr("interval 1 month"))


# (sin, cos) of a month's place on the yearly circle, as SQL text.
CYCLIC_SQL = ("sin({month} * 2 * pi() / 12)", "cos({month} * 2 * pi() / 12)")


def cyclic_month(month_num: Column) -> tuple[Column, Column]:
    """(sin, cos) of the month's place on the yearly circle."""
    angle = month_num * F.lit(2 * math.pi) / F.lit(12)
    return F.sin(angle), F.cos(angle)


def add_cyclic_month(df: DataFrame, month_num: str = "month_num") -> DataFrame:
    if month_num not in df.columns:
        raise KeyError(f"column {month_num!r} is missing")
    sin, cos = cyclic_month(F.col(month_num))
    return df.withColumns({"month_sin": sin, "month_cos": cos})
