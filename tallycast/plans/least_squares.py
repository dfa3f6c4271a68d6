"""Least squares on one to three features, solved per entity inside Catalyst.

The fit is one grouped aggregation of centred moments (map-side combined, so the
shuffle carries one small row per entity and task) followed by closed-form column
expressions. No matrix leaves the executors and no entity is looped over.

With S the feature covariances and b the covariances with the target, the
coefficients solve S w = b. A singular S (constant year, two points, collinear
months) gets the minimum-norm solution, which has a closed form as well: with
e1, e2, e3 the elementary symmetric functions of S's eigenvalues,

    rank 3   w = adj(S) b / e3
    rank 2   w = (e1 b - S b) / e2
    rank 1   w = b / e1
    rank 0   w = 0

because b always lies in the range of S.

Formulas are SQL text: they stay readable, and a plan of this size builds in
milliseconds where hundreds of chained Column calls take most of a second.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import CYCLIC_SQL
from tallycast.operators.grids import expand_horizon

# Eigenvalue ratio below which a direction counts as absent from the data.
RANK_TOLERANCE = 1e-10


def pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def moment_sql(features: Sequence[str], target: str) -> dict[str, str]:
    """Aggregates by name: n_obs, y_mean, x_mean_i, s_ij (i <= j) and b_i."""
    return {
        "n_obs": f"count({target})",
        "y_mean": f"avg({target})",
        **{f"x_mean_{i}": f"avg({x})" for i, x in enumerate(features)},
        **{f"s_{i}{j}": f"covar_pop({features[i]}, {features[j]})" for i, j in pairs(len(features))},
        **{f"b_{i}": f"covar_pop({x}, {target})" for i, x in enumerate(features)},
    }


def _s(i: int, j: int) -> str:
    return f"s_{min(i, j)}{max(i, j)}"


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def _standardised(moments: DataFrame, n: int) -> DataFrame:
    """Covariances turned into correlations; a constant feature keeps scale 1."""
    scaled = _with(moments, {f"scale_{i}": f"if(s_{i}{i} > 0, sqrt(s_{i}{i}), 1D)" for i in range(n)})
    return _with(
        scaled,
        {
            **{f"s_{i}{j}": f"s_{i}{j} / (scale_{i} * scale_{j})" for i, j in pairs(n)},
            **{f"b_{i}": f"b_{i} / scale_{i}" for i in range(n)},
        },
    )


def _cofactor(i: int, j: int) -> str:
    """Signed 2 x 2 minor of the 3 x 3 covariance matrix."""
    r = [k for k in range(3) if k != i]
    c = [k for k in range(3) if k != j]
    minor = f"({_s(r[0], c[0])} * {_s(r[1], c[1])} - {_s(r[0], c[1])} * {_s(r[1], c[0])})"
    return minor if (i + j) % 2 == 0 else f"(-{minor})"


def _sum(terms: Sequence[str]) -> str:
    return " + ".join(terms) if terms else "0D"


def _eliminated(moments: DataFrame, n: int) -> DataFrame:
    """``coef_i`` and ``rank`` of any number of features, by Gauss-Jordan steps over an array of rows.

    A feature that the ones before it explain (its variance left over is within the tolerance)
    gets the coefficient 0: the fitted values are those of least squares, the split is not
    the one of minimum norm.
    """
    matrix = ", ".join(f"array({', '.join([*[_s(i, j) for j in range(n)], f'b_{i}'])})" for i in range(n))
    spread = ", ".join(_s(i, i) for i in range(n))
    stepped = f"""aggregate(sequence(0, {n - 1}), array({matrix}), (m, k) ->
        IF(m[k][k] > {RANK_TOLERANCE}D * _spread[k],
            transform(m, (r, i) -> IF(i = k, transform(r, x -> x / m[k][k]), zip_with(r, m[k], (x, y) -> x - r[k] / m[k][k] * y))),
            transform(m, (r, i) -> IF(i = k, transform(r, x -> 0D), r))))"""
    df = _with(_with(moments, {"_spread": f"array({spread})"}), {"_m": stepped})
    df = _with(df, {**{f"coef_{i}": f"coalesce(_m[{i}][{n}], 0D)" for i in range(n)}, "rank": " + ".join(f"IF(_m[{i}][{i}] > 0, 1, 0)" for i in range(n))})
    return df.drop("_m", "_spread", *[_s(i, j) for i, j in pairs(n)], *[f"b_{i}" for i in range(n)])


def solve_moments(moments: DataFrame, n: int, standardise: bool = False) -> DataFrame:
    """Add ``coef_i`` and ``rank`` to rows of moments; the moments are dropped.

    With ``standardise`` the coefficients belong to features divided by
    ``scale_i``, which is kept. Up to three features are solved in closed form, more by elimination.
    """
    if n < 1:
        raise ValueError("one feature or more")
    df = _standardised(moments, n) if standardise else moments
    if n > 3:
        return _eliminated(df, n)
    e1 = _sum([_s(i, i) for i in range(n)])
    e2 = _sum([f"({_s(i, i)} * {_s(j, j)} - {_s(i, j)} * {_s(i, j)})" for i, j in pairs(n) if i != j])
    e3 = _sum([f"{_s(0, j)} * {_cofactor(0, j)}" for j in range(3)] if n == 3 else [])
    df = _with(df, {"_e1": f"coalesce({e1}, 0D)", "_e2": f"coalesce({e2}, 0D)", "_e3": f"coalesce({e3}, 0D)"})
    df = _with(
        df,
        {
            "rank": f"""CASE WHEN _e3 > {RANK_TOLERANCE}D * _e1 * _e2 THEN 3
                WHEN _e2 > {RANK_TOLERANCE}D * _e1 * _e1 THEN 2 WHEN _e1 > 0 THEN 1 ELSE 0 END"""
        },
    )

    def coefficient(i: int) -> str:
        s_b = _sum([f"{_s(i, j)} * b_{j}" for j in range(n)])
        adj_b = _sum([f"{_cofactor(j, i)} * b_{j}" for j in range(3)] if n == 3 else [])
        # try_divide: the engine may evaluate a branch ahead of its condition.
        return f"""CASE rank WHEN 3 THEN try_divide({adj_b}, _e3)
            WHEN 2 THEN try_divide(_e1 * b_{i} - ({s_b}), _e2)
            WHEN 1 THEN try_divide(b_{i}, _e1) ELSE 0D END"""

    df = _with(df, {f"coef_{i}": coefficient(i) for i in range(n)})
    spent = [f"s_{i}{j}" for i, j in pairs(n)] + [f"b_{i}" for i in range(n)] + ["_e1", "_e2", "_e3"]
    return df.drop(*spent)


def fit(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, standardise: bool = False
) -> DataFrame:
    """One row per key: n_obs, means, coefficients and rank. Features and target are SQL expressions."""
    doubles = [f"CAST({x} AS DOUBLE)" for x in features]
    moments = moment_sql(doubles, f"CAST({target} AS DOUBLE)")
    grouped = df.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in moments.items()])
    return solve_moments(grouped, len(features), standardise)


def fitted_value_sql(features: Sequence[str], standardise: bool = False) -> str:
    """The fitted value at the given feature values."""
    terms = ["y_mean"]
    for i, x in enumerate(features):
        scale = f" / scale_{i}" if standardise else ""
        terms.append(f"coef_{i} * ({x} - x_mean_{i}){scale}")
    return _sum(terms)


FeatureMaker = Callable[[str, str], list[str]]


def _ordinal(year: str, month: str) -> list[str]:
    return [year, month]


def _cyclic(year: str, month: str) -> list[str]:
    return [year, *[wave.format(month=month) for wave in CYCLIC_SQL]]


# kind: (features, standardised, least rows for a fit, what shorter series get)
KINDS: dict[str, tuple[FeatureMaker, bool, int, str]] = {
    "ordinal": (_ordinal, False, 1, "zero"),
    "standardised": (_ordinal, True, 1, "zero"),
    "cyclic": (_cyclic, False, 3, "zero"),
    "rebased": (_cyclic, False, 6, "mean_growth"),
}


def forecast_ols(
    monthly: DataFrame,
    entity: str,
    target_year: int,
    value: str = "timelog",
    features: str = "cyclic",
    min_rows: int | None = None,
    short: str | None = None,
    clamp: bool = True,
    growth_base_year: int | None = None,
    growth_rate: float = 0.05,
) -> DataFrame:
    """Twelve months of the target year per entity by least squares.

    ``features``: 'ordinal' (year, month number), 'standardised' (the same,
    each divided by its deviation), 'cyclic' (year, sin, cos) or 'rebased'
    (cyclic, with short series predicted by their mean times a growth factor).
    The year is counted from the target year; least squares with an intercept
    does not depend on that origin, and small numbers keep the moments exact.

    Series shorter than ``min_rows`` get zeros or the grown mean; a prediction
    that is no finite number becomes 0. ``fit_status`` says which case applied.
    """
    make, standardise, default_min, default_short = KINDS[features]
    min_rows = default_min if min_rows is None else min_rows
    base_year = target_year - 1 if growth_base_year is None else growth_base_year
    growth = 1.0 + growth_rate * (target_year - base_year)

    past = make(f"(year - {target_year})", "month_num")
    fitted = fit(monthly, [entity], past, value, standardise)
    future = expand_horizon(fitted, 12, "year", target_year)
    scored = _with(future, {"_raw": fitted_value_sql(make("0", "month_num"), standardise)})

    usable = "(_raw IS NOT NULL AND NOT isnan(_raw) AND abs(_raw) < double('infinity'))"
    fallback = f"coalesce(y_mean * {growth}D, 0D)" if (short or default_short) == "mean_growth" else "0D"
    predicted = "greatest(0D, _raw)" if clamp else "_raw"
    return scored.selectExpr(
        f"`{entity}`",
        "ds",
        "year",
        "month_num",
        f"CASE WHEN n_obs < {min_rows} THEN {fallback} WHEN {usable} THEN {predicted} ELSE 0D END AS yhat",
        "n_obs",
        f"""CASE WHEN n_obs < {min_rows} THEN 'short_history' WHEN NOT {usable} THEN 'failed'
            WHEN rank < {len(past)} THEN 'rank_deficient' ELSE 'ok' END AS fit_status""",
    )
