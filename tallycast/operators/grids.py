"""Calendar grids: gap filling, future months, day scaffolds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import month_index
from tallycast.operators.rollups import year_span
from tallycast.storage import materialise


def fill_months(
    monthly: DataFrame,
    entity: str,
    value: str = "timelog",
    first_year: int | None = None,
    last_year: int | None = None,
    fill: float = 0,
) -> DataFrame:
    """One row per entity and month over whole years, absent months filled.

    (entity, month_idx, year, month_num, value, observed). Without bounds each
    entity's own first and last month are used. Entities with no row inside the
    range do not appear.

    Every row emits itself and the empty months up to the entity's next row, so
    the grid is never built apart and joined: one shuffle on the entity, which
    later per-entity windows reuse.
    """
    first = "_at" if first_year is None else str(first_year * 12)
    after = "_at + 1" if last_year is None else str(last_year * 12 + 12)
    bounds = [f"_at >= {first_year * 12}"] if first_year is not None else []
    bounds += [f"_at < {last_year * 12 + 12}"] if last_year is not None else []
    order = f"OVER (PARTITION BY `{entity}` ORDER BY _at)"
    rows = monthly.selectExpr(f"`{entity}`", "CAST(year * 12 + month_num - 1 AS INT) AS _at", f"`{value}`")
    if bounds:
        rows = rows.filter(" AND ".join(bounds))
    spans = rows.selectExpr(
        "*",
        f"if(lag(_at) {order} IS NULL, {first}, _at) AS _from",
        f"coalesce(lead(_at) {order}, {after}) AS _until",
    )
    cells = spans.selectExpr("*", "explode(sequence(_from, _until - 1)) AS month_idx")
    return cells.selectExpr(
        f"`{entity}`",
        "month_idx",
        "CAST(month_idx DIV 12 AS INT) AS year",
        "CAST(month_idx % 12 + 1 AS INT) AS month_num",
        f"if(month_idx = _at, `{value}`, {fill}) AS `{value}`",
        "month_idx = _at AS observed",
    )


def fill_span(monthly: DataFrame, entity: str, value: str = "timelog", fill: float = 0) -> DataFrame:
    """``fill_months`` over the years from the table's first to its last one, whatever they are.

    The table is kept first, so that it is computed once for its span and its rows.
    """
    kept = materialise(monthly.select(entity, "year", "month_num", value), "monthly")
    years = year_span(kept)
    return fill_months(kept, entity, value, years[0], years[-1], fill) if years else fill_months(kept, entity, value, fill=fill)


def future_months(
    monthly: DataFrame,
    entity: str,
    periods: int = 12,
    anchor: str = "year",
    target_year: int | None = None,
) -> DataFrame:
    """(entity, ds, year, month_num, step): the months to be predicted.

    ``anchor='year'`` starts in January of the target year for every entity;
    ``anchor='last_obs'`` starts after the entity's own last observation. The
    months are generated per entity row, not cross joined.
    """
    index = month_index(F.col("year"), F.col("month_num"))
    last = monthly.groupBy(entity).agg(F.max(index).alias("_last"))
    return expand_horizon(last, periods, anchor, target_year).drop("_last", "_target")


def expand_horizon(
    entities: DataFrame, periods: int, anchor: str, target_year: int | None, last: str = "_last"
) -> DataFrame:
    """Repeat each entity row once per future month; adds step, ds, year, month_num."""
    if anchor == "year":
        if target_year is None:
            raise ValueError("anchor='year' needs a target_year")
        base = str(target_year * 12 - 1)
    elif anchor == "last_obs":
        base = last
    else:
        raise ValueError(f"unknown anchor {anchor!r}")
    return (
        entities.selectExpr("*", f"explode(sequence(1, {periods})) AS step")
        .selectExpr("*", f"CAST({base} + step AS INT) AS _target")
        .selectExpr(
            "*",
            "make_date(_target DIV 12, _target % 12 + 1, 1) AS ds",
            "CAST(_target DIV 12 AS INT) AS year",
            "CAST(_target % 12 + 1 AS INT) AS month_num",
        )
    )


def day_scaffold(
    logs: DataFrame, entity: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Every calendar day of the years for every entity, 29 February included.

    Without bounds the years are those from the first to the last ``date`` of ``logs``, which
    should then be a kept table.
    """
    if first_year is None or last_year is None:
        years = year_span(logs.select(F.year("date").alias("year")))
        if not years:
            return logs.select(entity, "date").limit(0)
        first_year, last_year = first_year or years[0], last_year or years[-1]
    days = F.sequence(
        F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
        F.make_date(F.lit(last_year), F.lit(12), F.lit(31)),
        F.expr("interval 1 day"),
    )
    return logs.select(entity).distinct().withColumn("date", F.explode(days))
