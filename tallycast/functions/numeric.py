"""Small numeric expressions used by the forecasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What counts as a number in text: decimal or exponent form, or a spelled-out NaN or infinity.
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?|(?i:nan|inf|infinity))\s*$"


def number_or_zero(value: Column) -> Column:
    """A numeric column as double; null and NaN become 0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def parse_or_zero(text: Column) -> Column:
    """A text column as double; what is no number, null and NaN become 0.

    The pattern keeps other text away from the cast, whose failures cost an
    exception each.
    """
    number = F.when(text.rlike(NUMBER_PATTERN), text)
    return F.coalesce(F.nanvl(number.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite_or_zero(value: Column) -> Column:
    return F.when(is_finite(value), value).otherwise(F.lit(0.0))


def clamp_zero(value: Column) -> Column:
    """Negative values become 0. Spark orders NaN above all numbers, so NaN goes first."""
    return F.greatest(F.lit(0.0), F.nanvl(value, F.lit(0.0)))


def years_since(year: Column, start: int) -> Column:
    return year - F.lit(start)


def growth_factor(target_year: int, base_year: int, rate: float = 0.05) -> Column:
    """1 + rate per year beyond the base year."""
    return F.lit(1.0 + rate * (target_year - base_year))


def round_half_even(value: Column, scale: int = 0) -> Column:
    return F.bround(value, scale)
