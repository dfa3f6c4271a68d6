"""Shared pieces of the query modules: output tidying and SQL building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.functions.calendar import MONTHS

# The last full year of the tables is the training end; the year after is predicted.
FIRST_YEAR = 1995
LAST_TRAIN_YEAR = 2000
TARGET_YEAR = 2001
ALL_YEARS = list(range(1995, 2002))


# Short integer series give fits that end exactly on half a unit of the fourth
# digit; this moves such halves to one side, whatever the last bit of a sum is.
_NUDGE = 1e-9


def round4(column: str | Column) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column) + _NUDGE, 4)


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to four digits, dates to text, flags to integers."""
    chosen = df.select(*columns) if columns else df

    plain = {
        T.DoubleType: f"round(`{{0}}` + {_NUDGE}D, 4) AS `{{0}}`",
        T.DateType: "date_format(`{0}`, 'yyyy-MM-dd') AS `{0}`",
        T.BooleanType: "CAST(`{0}` AS INT) AS `{0}`",
    }
    return chosen.selectExpr(
        *[plain.get(type(f.dataType), "`{0}`").format(f.name) for f in chosen.schema.fields]
    )


def r4(expr: str) -> str:
    """The same rounding in SQL; adding 0 turns a negative zero positive."""
    return f"(round({expr} + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE))"


def sql(ctes: list[str], body: str) -> str:
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


def _years(column: str, first: int | None, last: int | None) -> str:
    tests = []
    if first is not None:
        tests.append(f"year({column}) >= {first}")
    if last is not None:
        tests.append(f"year({column}) <= {last}")
    return ("WHERE " + " AND ".join(tests)) if tests else ""


_LINE = """CAST(l.l_shipdate AS DATE) AS date, CAST(year(l.l_shipdate) AS INTEGER) AS year,
    CAST(month(l.l_shipdate) AS INTEGER) AS month_num, CAST(l.l_quantity AS BIGINT) AS timelog"""
_BRAND = "CAST(replace(p.p_brand, 'Brand#', '') AS INTEGER) AS projectid, p.p_brand AS projectname"


def user_logs_cte(first=None, last=None) -> str:
    return f"""user_logs AS (
  SELECT s.s_name AS username, {_LINE}
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey {_years("l.l_shipdate", first, last)})"""


def project_logs_cte(first=None, last=None) -> str:
    return f"""project_logs AS (
  SELECT {_BRAND}, {_LINE}
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey {_years("l.l_shipdate", first, last)})"""


def full_logs_cte(first=None, last=None) -> str:
    return f"""full_logs AS (
  SELECT s.s_name AS username, {_BRAND}, {_LINE}
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey {_years("l.l_shipdate", first, last)})"""


def rollup_cte(name: str, source: str, entity: str) -> str:
    return f"""{name} AS (
  SELECT {entity}, year, month_num, CAST(sum(timelog) AS BIGINT) AS timelog
  FROM {source} GROUP BY {entity}, year, month_num)"""


def user_months_ctes(first=None, last=None) -> list[str]:
    return [user_logs_cte(first, last), rollup_cte("user_months", "user_logs", "username")]


def project_months_ctes(first=None, last=None) -> list[str]:
    return [project_logs_cte(first, last), rollup_cte("project_months", "project_logs", "projectname")]


def part_months_ctes(first=None, last=None) -> list[str]:
    logs = f"""part_logs AS (SELECT l.l_partkey AS partkey, {_LINE} FROM lineitem l
  {_years("l.l_shipdate", first, last)})"""
    return [logs, rollup_cte("part_months", "part_logs", "partkey")]


MONTH_LIST = "[" + ",".join(f"'{name}'" for name in MONTHS) + "]"


def month_name_sql(expr: str) -> str:
    return f"{MONTH_LIST}[{expr}]"


TWELVE = "(SELECT CAST(range AS INTEGER) AS month_num FROM range(1, 13))"


def ols_ctes(p: str, source: str, entity: str, target: int, kind: str, where: str = "") -> list[str]:
    """CTE chain ending in ``p`` (entity, year, month_num, yhat, n_obs, fit_status)."""
    wave = ["sin(2 * pi() * month_num / 12)", "cos(2 * pi() * month_num / 12)"]
    features = {
        "ordinal": ["year", "month_num"],
        "standardised": ["year", "month_num"],
        "cyclic": ["year", *wave],
        "rebased": ["year", *wave],
    }[kind]
    n = len(features)
    features[0] = f"(year - {target})"
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    moments = ", ".join(
        [f"avg(x{i}) AS m{i}" for i in range(n)]
        + [f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i, j in pairs]
        + [f"covar_pop(x{i}, y) AS b{i}" for i in range(n)]
    )
    out = [
        f"{p}_x AS (SELECT {entity}, CAST(timelog AS DOUBLE) AS y, {xs} FROM {source} {where})",
        f"{p}_raw AS (SELECT {entity}, count(y) AS n_obs, avg(y) AS ym, {moments} FROM {p}_x GROUP BY {entity})",
    ]
    means = ", ".join(f"m{i}" for i in range(n))
    if kind == "standardised":
        d = [f"(CASE WHEN s{i}{i} > 0 THEN sqrt(s{i}{i}) ELSE 1 END)" for i in range(n)]
    else:
        d = ["1"] * n
    scaled = ", ".join(
        [f"{d[i]} AS d{i}" for i in range(n)]
        + [f"s{i}{j} / ({d[i]} * {d[j]}) AS s{i}{j}" for i, j in pairs]
        + [f"b{i} / {d[i]} AS b{i}" for i in range(n)]
    )
    out.append(f"{p}_s AS (SELECT {entity}, n_obs, ym, {means}, {scaled} FROM {p}_raw)")

    def s(i, j):
        return f"s{min(i, j)}{max(i, j)}"

    e1 = " + ".join(s(i, i) for i in range(n))
    e2 = " + ".join(f"(s{i}{i} * s{j}{j} - s{i}{j} * s{i}{j})" for i, j in pairs if i != j)
    if n == 3:
        e3 = "s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02)"
        cramer = [
            "b0 * (s11 * s22 - s12 * s12) - s01 * (b1 * s22 - s12 * b2) + s02 * (b1 * s12 - s11 * b2)",
            "s00 * (b1 * s22 - s12 * b2) - b0 * (s01 * s22 - s12 * s02) + s02 * (s01 * b2 - b1 * s02)",
            "s00 * (s11 * b2 - b1 * s12) - s01 * (s01 * b2 - b1 * s02) + b0 * (s01 * s12 - s11 * s02)",
        ]
    else:
        e3, cramer = "0", ["0"] * n
    out.append(f"{p}_e AS (SELECT *, {e1} AS e1, {e2} AS e2, {e3} AS e3 FROM {p}_s)")
    rank = "CASE WHEN e3 > 1e-10 * e1 * e2 THEN 3 WHEN e2 > 1e-10 * e1 * e1 THEN 2 WHEN e1 > 0 THEN 1 ELSE 0 END"
    out.append(f"{p}_r AS (SELECT *, {rank} AS rk FROM {p}_e)")
    coefs = []
    for i in range(n):
        s_b = " + ".join(f"{s(i, j)} * b{j}" for j in range(n))
        coefs.append(
            f"CASE rk WHEN 3 THEN ({cramer[i]}) / e3 WHEN 2 THEN (e1 * b{i} - ({s_b})) / e2 "
            f"WHEN 1 THEN b{i} / e1 ELSE 0 END AS w{i}"
        )
    out.append(f"{p}_w AS (SELECT *, {', '.join(coefs)} FROM {p}_r)")
    at = ["0", *[f.replace("month_num", "t.month_num") for f in features[1:]]]
    pred = "ym + " + " + ".join(f"w{i} * ({at[i]} - m{i}) / d{i}" for i in range(n))
    least = {"ordinal": 1, "standardised": 1, "cyclic": 3, "rebased": 6}[kind]
    short = "ym * 1.05" if kind == "rebased" else "0"
    out.append(
        f"""{p} AS (SELECT {entity}, CAST({target} AS INTEGER) AS year, t.month_num,
  CASE WHEN n_obs < {least} THEN {short} ELSE greatest(0, {pred}) END AS yhat,
  {pred} AS unclamped, n_obs,
  CASE WHEN n_obs < {least} THEN 'short_history' WHEN rk < {n} THEN 'rank_deficient' ELSE 'ok' END AS fit_status
  FROM {p}_w CROSS JOIN {TWELVE} t)"""
    )
    return out


def seasonal_trend_ctes(p: str, source: str, entity: str, target: int) -> list[str]:
    """CTE chain ending in ``p``: trend times normalised month index, 12 months after the last one."""
    k = "(year * 12 + month_num - 1 - 24000)"
    return [
        f"{p}_k AS (SELECT {entity}, month_num, CAST({k} AS DOUBLE) AS k, CAST(timelog AS DOUBLE) AS y FROM {source})",
        f"""{p}_t AS (SELECT {entity}, regr_slope(y, k) AS slope, regr_intercept(y, k) AS level,
  CAST(max(k) AS INTEGER) AS last_k, count(*) AS n_obs FROM {p}_k GROUP BY {entity} HAVING count(*) >= 2)""",
        f"""{p}_i AS (SELECT {entity}, month_num, avg(y / nullif(level + slope * k, 0)) AS r
  FROM {p}_k JOIN {p}_t USING ({entity}) GROUP BY {entity}, month_num)""",
        f"{p}_n AS (SELECT {entity}, avg(r) AS scale FROM {p}_i GROUP BY {entity})",
        f"""{p}_h AS (SELECT {entity}, slope, level, n_obs, last_k + h AS k,
  CAST((24000 + last_k + h) // 12 AS INTEGER) AS year, CAST((24000 + last_k + h) % 12 + 1 AS INTEGER) AS month_num
  FROM {p}_t CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, 13)))""",
        f"""{p} AS (SELECT h.{entity}, h.year, h.month_num,
  (level + slope * k) * coalesce(i.r / nullif(n.scale, 0), 1) AS yhat, n_obs
  FROM {p}_h h JOIN {p}_n n ON h.{entity} = n.{entity}
  LEFT JOIN {p}_i i ON h.{entity} = i.{entity} AND h.month_num = i.month_num WHERE h.year = {target})""",
    ]


def grid_ctes(p: str, source: str, entity: str, first: int | None = None, last: int | None = None) -> list[str]:
    """CTE ``p`` (entity, month_idx, year, month_num, timelog, observed) on the full grid, by default over all years there."""
    if first is None or last is None:
        return [
            f"""{p}_i AS (SELECT unnest(range(lo, hi)) AS idx FROM
  (SELECT min(year) * 12 AS lo, max(year) * 12 + 12 AS hi FROM {source}))""",
            f"""{p} AS (SELECT e.{entity}, CAST(i.idx AS INTEGER) AS month_idx, CAST(i.idx // 12 AS INTEGER) AS year,
  CAST(i.idx % 12 + 1 AS INTEGER) AS month_num, coalesce(m.timelog, 0) AS timelog,
  CASE WHEN m.timelog IS NULL THEN 0 ELSE 1 END AS observed
  FROM (SELECT DISTINCT {entity} FROM {source}) e CROSS JOIN {p}_i i
  LEFT JOIN {source} m ON m.{entity} = e.{entity} AND m.year * 12 + m.month_num - 1 = i.idx)""",
        ]
    lo, hi = first * 12, last * 12 + 12
    return [
        f"""{p} AS (SELECT e.{entity}, CAST(i.idx AS INTEGER) AS month_idx, CAST(i.idx // 12 AS INTEGER) AS year,
  CAST(i.idx % 12 + 1 AS INTEGER) AS month_num, coalesce(m.timelog, 0) AS timelog,
  CASE WHEN m.timelog IS NULL THEN 0 ELSE 1 END AS observed
  FROM (SELECT DISTINCT {entity} FROM {source} WHERE year BETWEEN {first} AND {last}) e
  CROSS JOIN (SELECT range AS idx FROM range({lo}, {hi})) i
  LEFT JOIN {source} m ON m.{entity} = e.{entity} AND m.year * 12 + m.month_num - 1 = i.idx)"""
    ]


def seasonal_ar_ctes(p: str, source: str, entity: str, first: int, last: int) -> list[str]:
    """CTE chain ending in ``p``: seasonal difference with an AR(1) slope."""
    end = last * 12 + 11
    return [
        *grid_ctes(f"{p}_g", source, entity, first, last),
        f"""{p}_z AS (SELECT *, CAST(timelog - lag(timelog, 12) OVER (PARTITION BY {entity} ORDER BY month_idx)
  AS DOUBLE) AS z FROM {p}_g)""",
        f"{p}_l AS (SELECT *, lag(z) OVER (PARTITION BY {entity} ORDER BY month_idx) AS z1 FROM {p}_z)",
        f"""{p}_c AS (SELECT {entity}, sum(observed) AS n_obs,
  greatest(-0.99, least(0.99, coalesce(sum(z * z1) / nullif(sum(z1 * z1), 0), 0))) AS phi,
  max(CASE WHEN month_idx = {end} THEN z END) AS last_z FROM {p}_l GROUP BY {entity})""",
        f"""{p} AS (SELECT g.{entity}, CAST({last + 1} AS INTEGER) AS year, g.month_num,
  g.timelog + pow(c.phi, g.month_num) * c.last_z AS yhat, CAST(c.n_obs AS BIGINT) AS n_obs
  FROM {p}_g g JOIN {p}_c c ON g.{entity} = c.{entity} WHERE g.year = {last})""",
    ]


def solve_ctes(p: str, source: str, key: str, n: int) -> list[str]:
    """CTE ``p`` (key, coef): linear systems by Gauss-Jordan steps, one system per key.

    ``source`` holds the rows' vectors: (key, v) with v = n regressors and the target.
    """
    step = f"""list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda c: c / m[k][k])
    ELSE list_transform(r, lambda c, j: c - r[k] * m[k][j] / m[k][k]) END)"""
    return [
        f"""{p}_n AS (SELECT {key}, i, j, sum(v[i] * v[j]) AS s FROM {source},
  (SELECT CAST(range AS INTEGER) AS i FROM range(1, {n + 1})), (SELECT CAST(range AS INTEGER) AS j FROM range(1, {n + 2}))
  GROUP BY {key}, i, j)""",
        f"""{p}_m AS (SELECT {key}, list(r ORDER BY i) AS m FROM (SELECT {key}, i, list(s ORDER BY j) AS r
  FROM {p}_n GROUP BY {key}, i) GROUP BY {key})""",
        f"""{p}_g AS (SELECT {key}, 1 AS k, m FROM {p}_m
  UNION ALL SELECT {key}, k + 1, {step} FROM {p}_g WHERE k <= {n})""",
        f"{p} AS (SELECT {key}, list_transform(m, lambda r: r[{n + 1}]) AS coef FROM {p}_g WHERE k = {n + 1})",
    ]


def pooled_ar_ctes(p: str, source: str, entity: str, first: int, last: int) -> list[str]:
    """CTE chain ending in ``p``: pooled autoregression on scaled 12-month windows."""
    past = f"list(s) OVER (PARTITION BY {entity} ORDER BY month_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    return [
        *grid_ctes(f"{p}_grid", source, entity, first, last),
        f"""{p}_span AS (SELECT {entity}, CAST(min(timelog) AS DOUBLE) AS low,
  CAST(CASE WHEN max(timelog) = min(timelog) THEN 1 ELSE max(timelog) - min(timelog) END AS DOUBLE) AS span,
  count(*) AS n_obs FROM {p}_grid GROUP BY {entity})""",
        f"{p}_s AS (SELECT {entity}, month_idx, (timelog - low) / span AS s FROM {p}_grid JOIN {p}_span USING ({entity}))",
        f"{p}_lags AS (SELECT {entity}, month_idx, s, {past} AS x FROM {p}_s)",
        f"{p}_v AS (SELECT 1 AS one, list_concat(x, [1.0::DOUBLE, s]) AS v FROM {p}_lags WHERE len(x) = 12)",
        *solve_ctes(f"{p}_w", f"{p}_v", "one", 13),
        f"""{p}_path AS (SELECT {entity}, 0 AS h, list(s ORDER BY month_idx) AS x FROM {p}_s
  WHERE month_idx >= {last * 12} GROUP BY {entity}
  UNION ALL SELECT {entity}, h + 1, list_append(x[2:], list_dot_product(x, coef[1:12]) + coef[13])
  FROM {p}_path, {p}_w WHERE h < 12)""",
        f"""{p} AS (SELECT {entity}, CAST({last + 1} AS INTEGER) AS year, CAST(h AS INTEGER) AS month_num,
  x[12] * span + low AS yhat, n_obs FROM {p}_path JOIN {p}_span USING ({entity}) WHERE h > 0)""",
    ]


def pooled_hinge_ctes(p: str, source: str, entity: str, target: int) -> list[str]:
    """CTE chain ending in ``p``: pooled least squares on hinges of the year and the cyclic month."""
    year = "((year - year_mean) / year_std)"
    wave = ["sin(2 * pi() * month_num / 12)", "cos(2 * pi() * month_num / 12)"]
    units = [year, *wave, *[f"greatest(0, {year} - ({k}))" for k in (-1, 0, 1)], *[f"greatest(0, {w})" for w in wave]]
    x = ", ".join(f"CAST({u} AS DOUBLE)" for u in units)
    n = len(units) + 1
    return [
        f"""{p}_e AS (SELECT {entity}, count(*) AS n_obs, avg(timelog) AS y_mean,
  CASE WHEN stddev_pop(timelog) > 0 THEN stddev_pop(timelog) ELSE 1 END AS y_std FROM {source} GROUP BY {entity})""",
        f"{p}_s AS (SELECT avg(year) AS year_mean, stddev_pop(year) AS year_std FROM {source})",
        f"""{p}_v AS (SELECT 1 AS one, [{x}, 1, (timelog - y_mean) / y_std] AS v
  FROM {source} JOIN {p}_e USING ({entity}), {p}_s WHERE n_obs >= 3)""",
        *solve_ctes(f"{p}_w", f"{p}_v", "one", n),
        f"""{p} AS (SELECT {entity}, CAST({target} AS INTEGER) AS year, month_num, n_obs,
  CASE WHEN n_obs < 3 THEN 0 ELSE greatest(0, y_mean + y_std * list_dot_product([{x}, 1], coef)) END AS yhat,
  CASE WHEN n_obs < 3 THEN 'short_history' ELSE 'ok' END AS fit_status
  FROM (SELECT e.*, s.*, w.coef, t.month_num, {target} AS year FROM {p}_e e, {p}_s s, {p}_w w, {TWELVE} t))""",
    ]


def seasonal_arma_ctes(p: str, source: str, entity: str, first: int, last: int) -> list[str]:
    """CTE chain ending in ``p``: seasonal difference, AR(1), MA at lags 1 and 12 by two regressions."""
    n = (last - first) * 12
    order = max(1, min(13, (n - 12) // 3))
    lags = ", ".join(f"w[t - {i}]" for i in range(1, order + 1))
    at = "(CASE WHEN t >= {1} THEN {0}[t + 1 - {1}] ELSE 0 END)"
    mean = (
        f"phi * {at.format('w', 1)} + theta * {at.format('a', 1)} + sma * {at.format('a', 12)}"
        f" + theta * sma * {at.format('a', 13)}"
    )
    return [
        *grid_ctes(f"{p}_grid", source, entity, first, last),
        f"""{p}_y AS (SELECT {entity}, list(CAST(timelog AS DOUBLE) ORDER BY month_idx) AS y,
  CAST(sum(observed) AS BIGINT) AS n_obs FROM {p}_grid GROUP BY {entity})""",
        f"""{p}_d AS (SELECT {entity}, y, n_obs,
  list_transform(range(1, {n + 1}), lambda t: y[t + 12] - y[t]) AS w FROM {p}_y)""",
        f"""{p}_v1 AS (SELECT {entity}, [{lags}, w[t]] AS v FROM {p}_d,
  (SELECT range AS t FROM range({order + 1}, {n + 1})))""",
        *solve_ctes(f"{p}_ar", f"{p}_v1", entity, order),
        f"""{p}_e AS (SELECT d.*, list_transform(range(1, {n + 1}), lambda t: CASE WHEN t <= {order} THEN 0
    ELSE w[t] - list_dot_product([{lags}], coef) END) AS e FROM {p}_d d JOIN {p}_ar USING ({entity}))""",
        f"""{p}_v2 AS (SELECT {entity}, [w[t - 1], e[t - 1], e[t - 12], w[t]] AS v FROM {p}_e,
  (SELECT range AS t FROM range({order + 13}, {n + 1})))""",
        *solve_ctes(f"{p}_ma", f"{p}_v2", entity, 3),
        f"""{p}_c AS (SELECT {entity}, y, w, n_obs, greatest(-0.99, least(0.99, coef[1])) AS phi,
  greatest(-0.99, least(0.99, coef[2])) AS theta, greatest(-0.99, least(0.99, coef[3])) AS sma
  FROM {p}_d JOIN {p}_ma USING ({entity}))""",
        f"""{p}_path AS (SELECT {entity}, 0 AS t, y, w, CAST([] AS DOUBLE[]) AS a, n_obs, phi, theta, sma FROM {p}_c
  UNION ALL SELECT {entity}, t + 1, y, CASE WHEN t < {n} THEN w ELSE list_append(w, {mean}) END,
  list_append(a, CASE WHEN t < {n} THEN w[t + 1] - ({mean}) ELSE 0 END), n_obs, phi, theta, sma
  FROM {p}_path WHERE t < {n + 12})""",
        f"""{p} AS (SELECT {entity}, CAST({last + 1} AS INTEGER) AS year, h AS month_num,
  y[{n} + h] + w[{n} + h] AS yhat, n_obs FROM {p}_path, (SELECT CAST(range AS INTEGER) AS h FROM range(1, 13))
  WHERE t = {n + 12})""",
    ]
