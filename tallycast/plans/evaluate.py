"""Backtests, error measures and model comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.operators.filters import split_by_year
from tallycast.operators.joins import align
from tallycast.operators.ranking import top_k
from tallycast.storage import materialise

Model = Callable[[DataFrame], DataFrame]


def backtest(
    monthly: DataFrame, entity: str, test_year: int, model: Model, value: str = "timelog"
) -> DataFrame:
    """Fit on the years before ``test_year`` and set the prediction beside what happened.

    (entity, year, month_num, predicted, actual); a side without a row is null.

    ``monthly`` is read for the training years and again for the test year.
    Over a log laid out by date that reads each part once; otherwise hand in a
    materialised rollup, so that the log is scanned a single time.
    """
    train, actual = split_by_year(monthly, test_year - 1)
    predicted = model(train).filter(F.col("year") == test_year)
    return align(predicted, actual, [entity, "year", "month_num"], actual_col=value)


# Rows without one of the sides count in none of them.
_ERRORS = {
    "n": "count(actual - predicted)",
    "mse": "avg((actual - predicted) * (actual - predicted))",
    "rmse": "sqrt(avg((actual - predicted) * (actual - predicted)))",
    "mae": "avg(abs(actual - predicted))",
    "mape": "avg(try_divide(abs(actual - predicted), abs(actual))) * 100",
}


def _errors() -> list[Column]:
    return [F.expr(text).alias(name) for name, text in _ERRORS.items()]


def accuracy(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Errors over the rows that have both sides, per key or overall.

    (keys, n, mse, rmse, mae, mape); mape is in percent and leaves out months
    whose actual value is 0.
    """
    both = aligned.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    return both.groupBy(*keys).agg(*_errors())


def stack_models(forecasts: Mapping[str, DataFrame]) -> DataFrame:
    """One table of all forecasts with a ``model`` column."""
    stacked = None
    for name, forecast in forecasts.items():
        labelled = forecast.withColumn("model", F.lit(name))
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    if stacked is None:
        raise ValueError("no forecasts given")
    return stacked


def compare_models(
    forecasts: Mapping[str, DataFrame], actual: DataFrame, entity: str, value: str = "timelog"
) -> DataFrame:
    """Every forecast row beside its actual: (model, entity, year, month_num, predicted, actual, compared).

    ``compared`` marks the months of an entity that every model predicts and that have an
    actual value, so that errors over them are taken from the same months for all models.
    The forecasts are computed once, in one job, and kept; all that follows reads the kept table.
    """
    known = actual.select(entity, "year", "month_num", F.col(value).cast("double").alias("actual"))
    slim = {m: f.select(entity, "year", "month_num", F.col("yhat").alias("predicted")) for m, f in forecasts.items()}
    predicted = materialise(stack_models(slim), "model-forecasts").select("model", entity, "year", "month_num", "predicted")
    keys = [entity, "year", "month_num"]
    covered = predicted.groupBy(*keys).agg((F.count_distinct("model") == len(forecasts)).alias("_all"))
    beside = covered.join(known, keys, "left")
    compared = F.col("_all") & F.col("actual").isNotNull()
    return predicted.join(beside.withColumn("compared", compared).drop("_all"), keys)


def model_errors(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``accuracy`` per model over the months that all models cover, with the share of each
    model's own predicted months that they are (``coverage``)."""
    share = F.avg(F.col("compared").cast("double")).alias("coverage")
    covered = compared.withColumn("predicted", F.when(F.col("compared"), F.col("predicted")))
    return covered.groupBy(*keys, "model").agg(*_errors(), share).filter("n > 0")


def best_model(compared: DataFrame, entity: str, by: str = "rmse", digits: int = 4) -> DataFrame:
    """The model with the smallest error per entity, from ``compare_models``.

    Errors that agree to ``digits`` are equal, and go to the first name: models that are the
    same line in other units differ in their last bits only.
    """
    errors = model_errors(compared, [entity]).withColumn("_rounded", F.round(by, digits))
    return top_k(errors, [entity], "_rounded", ["model"], smallest=True).drop("_rounded")
