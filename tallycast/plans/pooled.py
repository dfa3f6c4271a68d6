"""Learners fitted once over all entities.

The linear ones are one aggregate of moments and its solution, the trees are MLlib's. Fitting
runs its jobs at once and brings back only the fitted model (13 weights, or a fixed number of small trees). The training table feeds
both the fit and the scoring, so it is kept in reliable storage in between and
the log is read once.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.calendar import cyclic_month, month_index
from tallycast.functions.numeric import clamp_zero, finite_or_zero
from tallycast.operators.grids import expand_horizon, fill_months
from tallycast.operators.scaling import inverse_minmax, minmax_scale
from tallycast.storage import materialise


def lag_frame(
    monthly: DataFrame,
    entity: str,
    value: str = "timelog",
    lags: int = 12,
    first_year: int | None = None,
    last_year: int | None = None,
    fill_gaps: bool = True,
) -> DataFrame:
    """Scaled windows ending at each month: (entity, month_idx, recent, target, low, span, n_obs, n_seen).

    ``n_obs`` counts the months of the grid, ``n_seen`` those that were not filled in. ``target`` is the month after the window, null on the entity's last row.
    One window pass yields the training rows and the forecasting context.
    """
    if fill_gaps:
        grid = fill_months(monthly, entity, value, first_year, last_year)
    else:
        grid = monthly.select(
            entity, month_index(F.col("year"), F.col("month_num")).alias("month_idx"), value, F.lit(True).alias("observed")
        )
    order = Window.partitionBy(entity).orderBy("month_idx")
    whole = Window.partitionBy(entity)
    scaled = minmax_scale(grid, entity, value).withColumns(
        {"n_obs": F.count(F.lit(1)).over(whole), "n_seen": F.count_if("observed").over(whole)}
    )
    return (
        scaled.filter(F.col("n_obs") > lags)
        .withColumns(
            {
                "recent": F.collect_list("scaled").over(order.rowsBetween(-(lags - 1), 0)),
                "target": F.lead("scaled").over(order),
            }
        )
        .filter(F.size("recent") == lags)
        .select(entity, "month_idx", "recent", "target", "low", "span", "n_obs", "n_seen")
    )


def roll_forward(context: Column, weights: list[float], intercept: float, periods: int) -> Column:
    """Array of ``periods`` predictions, each fed back as the newest lag."""
    w = F.array(*[F.lit(float(x)) for x in weights])

    def step(state: Column, _: Column) -> Column:
        terms = F.zip_with(state["lags"], w, lambda a, b: a * b)
        nxt = F.aggregate(terms, F.lit(float(intercept)), lambda acc, t: acc + t)
        shifted = F.concat(F.slice(state["lags"], 2, len(weights) - 1), F.array(nxt))
        return F.struct(shifted.alias("lags"), F.concat(state["out"], F.array(nxt)).alias("out"))

    start = F.struct(context.alias("lags"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(periods)), start, step, lambda state: state["out"])


def _weights(train: DataFrame, features: list[str], target: str) -> tuple[list[float], float, int]:
    """Least squares over all rows: weights, intercept and number of rows.

    One aggregate of sums and products sends one row to the driver, which solves for the weights
    (those of least norm, where features repeat each other). Features are of similar size, about 1.
    """
    terms = ["1D", *features, target]
    cells = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    row = train.select(*[F.expr(t).cast("double").alias(f"t{i}") for i, t in enumerate(terms)])
    row = row.agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in cells]).first()
    products = np.zeros((len(terms), len(terms)))
    for (i, j), value in zip(cells, row):
        products[i, j] = products[j, i] = value or 0.0
    solved = np.linalg.lstsq(products[:-1, :-1], products[:-1, -1], rcond=1e-12)[0]
    return solved[1:].tolist(), float(solved[0]), int(products[0, 0])


def forecast_pooled_ar(
    monthly: DataFrame,
    entity: str,
    target_year: int,
    value: str = "timelog",
    lags: int = 12,
    periods: int = 12,
    first_year: int | None = None,
    fill_gaps: bool = True,
) -> DataFrame:
    """Autoregression on min-max scaled lag windows, one set of weights for all entities.

    Each entity's last window is rolled forward from January of the target year
    and scaled back. Entities with fewer than lags + 1 months drop out; those whose grid is
    mostly filled in (fewer than lags + 1 months seen) are marked ``short_history``. No clamp.
    """
    last_year = target_year - 1 if fill_gaps else None
    frame = materialise(lag_frame(monthly, entity, value, lags, first_year, last_year, fill_gaps))
    weights, intercept, _ = _weights(frame.filter(F.col("target").isNotNull()), [f"recent[{k}]" for k in range(lags)], "target")
    path = roll_forward(F.col("recent"), weights, intercept, periods)
    scored = frame.filter(F.col("target").isNull()).withColumn("_path", path)
    future = expand_horizon(scored, periods, "year", target_year)
    yhat = inverse_minmax(F.element_at("_path", F.col("step")), F.col("low"), F.col("span"))
    status = F.when(F.col("n_seen") > lags, "ok").otherwise("short_history")
    return future.select(entity, "ds", "year", "month_num", yhat.alias("yhat"), "n_obs", status.alias("fit_status"))


# Joints of the year's bends and of the two waves, in standard units.
_YEAR_JOINTS, _WAVE_JOINTS = (-1.0, 0.0, 1.0), (0.0,)
HINGE_FEATURES = 3 + len(_YEAR_JOINTS) + 2 * len(_WAVE_JOINTS)


def _hinge_features(df: DataFrame) -> list[Column]:
    sin, cos = cyclic_month(F.col("month_num"))
    year = (F.col("year") - F.col("year_mean")) / F.col("year_std")
    bends = [F.greatest(F.lit(0.0), year - k) for k in _YEAR_JOINTS]
    waves = [F.greatest(F.lit(0.0), wave - k) for wave in (sin, cos) for k in _WAVE_JOINTS]
    return [year, sin, cos, *bends, *waves]


def forecast_pooled_hinges(
    monthly: DataFrame, entity: str, target_year: int, value: str = "timelog", min_rows: int = 3
) -> DataFrame:
    """One hidden layer of fixed rectified units over all entities, its output weights fitted exactly.

    Inputs are the year, standardised over all rows, and the cyclic month; units bend at fixed
    joints. Each entity's values are standardised by its own mean and deviation, so one set of
    weights (least squares over all rows) serves all. Entities below ``min_rows`` values get
    zeros; predictions are clamped at zero.
    """
    rows = monthly.select(entity, "year", "month_num", F.col(value).cast("double").alias("_y")).filter("_y IS NOT NULL")
    level = rows.groupBy(entity).agg(
        F.count("_y").alias("n_obs"),
        F.avg("_y").alias("y_mean"),
        F.expr("if(stddev_pop(_y) > 0, stddev_pop(_y), 1D)").alias("y_std"),
    )
    history = materialise(rows.join(level, entity), "hinges")
    span = history.agg(F.avg("year").alias("m"), F.stddev_pop("year").alias("s")).first()
    mean, spread = span.m or 0.0, span.s or 1.0
    shared = {"year_mean": F.lit(float(mean)), "year_std": F.lit(float(spread))}
    names = [f"h{i}" for i in range(HINGE_FEATURES)]

    def with_features(df: DataFrame) -> DataFrame:
        wide = df.withColumns(shared)
        return wide.withColumns(dict(zip(names, _hinge_features(wide))))

    train = with_features(history.filter(F.col("n_obs") >= min_rows)).withColumn(
        "label", (F.col("_y") - F.col("y_mean")) / F.col("y_std")
    )
    future = with_features(
        expand_horizon(history.select(entity, "n_obs", "y_mean", "y_std").dropDuplicates([entity]), 12, "year", target_year)
    )
    weights, intercept, n_rows = _weights(train, names, "label")
    shape = reduce(add, [F.lit(float(w)) * F.col(n) for w, n in zip(weights, names)], F.lit(float(intercept)))
    raw = finite_or_zero(F.col("y_mean") + F.col("y_std") * shape) if n_rows else F.lit(0.0)
    shortened = F.col("n_obs") < min_rows
    return future.select(
        entity,
        "ds",
        "year",
        "month_num",
        F.when(shortened, 0.0).otherwise(clamp_zero(raw)).alias("yhat"),
        "n_obs",
        F.when(shortened, "short_history").otherwise("ok").alias("fit_status"),
    )


_TREE_FEATURES = ["year_z", "month_sin", "month_cos", "variation", "trend"]


def _tree_features(df: DataFrame) -> DataFrame:
    sin, cos = cyclic_month(F.col("month_num"))
    return df.withColumns(
        {
            "year_z": (F.col("year") - F.col("year_mean")) / F.col("year_std"),
            "month_sin": sin,
            "month_cos": cos,
            "variation": F.coalesce(F.try_divide(F.col("y_std"), F.col("y_mean")), F.lit(0.0)),
            "trend": F.col("year_slope") * F.col("year_std") / F.col("y_std"),
        }
    )


def forecast_pooled_gbt(
    monthly: DataFrame,
    entity: str,
    target_year: int,
    value: str = "timelog",
    min_rows: int = 3,
    max_iter: int = 10,
    max_depth: int = 4,
    step_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Gradient-boosted trees on standardised year and cyclic month, over all entities.

    Each entity's target is standardised by its own mean and deviation; its
    variation and yearly trend enter as features, so the trees learn shapes that
    entities share. Entities below ``min_rows`` get zeros; predictions are
    clamped at zero and non-numbers become 0.
    """
    group = Window.partitionBy(entity)
    year = F.col("year").cast("double")
    deviation, year_deviation = F.stddev_pop("_y").over(group), F.stddev_pop(year).over(group)
    history = materialise(
        monthly.select(entity, "year", "month_num", F.col(value).cast("double").alias("_y")).withColumns(
            {
                "n_obs": F.count("_y").over(group),
                "y_mean": F.avg("_y").over(group),
                "y_std": F.when(deviation > 0, deviation).otherwise(1.0),
                "year_mean": F.avg(year).over(group),
                "year_std": F.when(year_deviation > 0, year_deviation).otherwise(1.0),
                "year_slope": F.coalesce(F.regr_slope(F.col("_y"), year).over(group), F.lit(0.0)),
            }
        )
    )
    train = _tree_features(history.filter(F.col("n_obs") >= min_rows)).withColumn(
        "label", (F.col("_y") - F.col("y_mean")) / F.col("y_std")
    )
    assembler = VectorAssembler(inputCols=_TREE_FEATURES, outputCol="features")
    model = GBTRegressor(maxIter=max_iter, maxDepth=max_depth, stepSize=step_size, seed=seed).fit(
        assembler.transform(train).select("features", "label")
    )
    entities = history.drop("year", "month_num", "_y").dropDuplicates([entity])  # the rest is equal per entity
    future = _tree_features(expand_horizon(entities, 12, "year", target_year))
    scored = model.transform(assembler.transform(future))
    raw = finite_or_zero(F.col("y_mean") + F.col("y_std") * F.col("prediction"))
    shortened = F.col("n_obs") < min_rows
    return scored.select(
        entity,
        "ds",
        "year",
        "month_num",
        F.when(shortened, 0.0).otherwise(clamp_zero(raw)).alias("yhat"),
        "n_obs",
        F.when(shortened, "short_history").otherwise("ok").alias("fit_status"),
    )
