from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallycast.operators import apportion, charts, filters, grids, joins, quality, ranking, rollups, scaling, windows
from tests.conftest import rows


def logs(spark, data):
    return spark.createDataFrame(data, "username string, year int, month_num int, projectid int, timelog long")


# ---- rollups ----


def test_rollup_sums_means_and_skips_null_keys(spark):
    df = logs(
        spark,
        [("a", 2020, 1, 2, 5), ("a", 2020, 1, 3, 7), ("a", None, 1, 1, 9), (None, 2020, 1, 1, 9), ("b", 2020, 2, 4, None)],
    )
    got = rollups.monthly_rollup(df, "username", means=["projectid"])
    assert rows(got) == [("a", 2020, 1, 12, 2.5), ("b", 2020, 2, 0, 4.0)]


def test_rollup_does_not_depend_on_partitioning(spark):
    rng = random.Random(1)
    data = [(f"u{rng.randint(1, 5)}", 2020, rng.randint(1, 12), rng.randint(1, 3), rng.randint(-5, 50)) for _ in range(500)]
    whole = rows(rollups.monthly_rollup(logs(spark, data), "username"))
    for n in (1, 7):
        assert rows(rollups.monthly_rollup(logs(spark, data).repartition(n), "username")) == whole


def _lookup_case(spark):
    """One key holds a third of the rows; two keys share a name."""
    rng = random.Random(2)
    data = [(1 if rng.random() < 0.34 else rng.randint(2, 40), 2020, rng.randint(1, 12), rng.randint(1, 50)) for _ in range(3000)]
    facts = spark.createDataFrame(data, "key int, year int, month_num int, timelog long")
    names = {k: f"name{min(k, 30)}" for k in range(1, 41)}
    dimension = spark.createDataFrame(list(names.items()), "key int, name string")
    expected = Counter()
    for k, y, m, v in data:
        expected[(names[k], y, m)] += v
    return facts, dimension, sorted((*k, v) for k, v in expected.items())


def test_rollup_by_lookup_small_dimension(spark):
    facts, dimension, expected = _lookup_case(spark)
    got = joins.rollup_by_lookup(facts, dimension, "key", "name")
    assert rows(got) == expected


def test_rollup_by_lookup_beyond_broadcast(spark, no_broadcast):
    facts, dimension, expected = _lookup_case(spark)
    got = joins.rollup_by_lookup(facts, dimension, "key", "name")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    # The join moves monthly sums, not log rows: an aggregation lies below it.
    assert plan.index("SortMergeJoin") < plan.index("partial_sum(timelog#", plan.index("SortMergeJoin"))
    assert rows(got) == expected


def test_cells_serve_the_other_rollups(spark):
    rng = random.Random(3)
    data = []
    for _ in range(300):
        project = rng.randint(1, 3)
        data.append((f"u{rng.randint(1, 4)}", 2020, rng.randint(1, 3), project, rng.randint(0, 9), f"P{project}"))
    schema = "username string, year int, month_num int, projectid int, timelog long, projectname string"
    df = spark.createDataFrame(data, schema)
    cells = rollups.log_cells(df)
    direct = rollups.monthly_rollup(df, "username", means=["projectid"])
    again = rollups.user_months_with_project(cells)
    assert [(*r[:4], round(r[4], 9)) for r in rows(again)] == [(*r[:4], round(r[4], 9)) for r in rows(direct)]
    assert rows(rollups.monthly_rollup(cells, "projectname")) == rows(rollups.monthly_rollup(df, "projectname"))


def test_month_totals_expand_to_whole_years(monthly):
    df = monthly({"a": [(2020, 1, 5), (2021, 12, 7)], "b": [(2020, 1, 2)]})
    assert rows(rollups.monthly_total(df)) == [(2020, 1, 7), (2021, 12, 7)]
    wide = rows(rollups.monthly_total(df, expand_months=True))
    assert len(wide) == 24 and sum(r[2] for r in wide) == 14 and (2020, 7, 0) in wide


def test_population_mean(monthly):
    df = monthly({"a": [(2020, 1, 10), (2020, 2, 20)], "b": [(2020, 1, 30)]})
    assert rollups.population_mean(df, "entity").first()[0] == pytest.approx((40 + 20) / 2 / 2)
    assert rollups.population_mean(df.limit(0), "entity").first()[0] is None


def test_counts_and_means(monthly):
    df = monthly({"a": [(2020, 1, 10), (2020, 2, 20)], "b": [(2020, 1, 30)]})
    assert rows(rollups.rows_per_entity(df, "entity")) == [("a", 2), ("b", 1)]
    assert rows(rollups.mean_per_entity(df, "entity")) == [("a", 15.0), ("b", 30.0)]
    assert rollups.count_entities(df, "entity").first()[0] == 2
    assert rollups.count_entities(df, "entity", approximate=True).first()[0] == 2


# ---- filters and checks ----


def test_year_range_reaches_date_and_year(spark):
    df = spark.createDataFrame([(dt.date(y, 6, 1), y) for y in range(2018, 2026)], "date date, year int")
    assert [r.year for r in filters.year_between(df, 2020, 2024).orderBy("year").collect()] == list(range(2020, 2025))


def test_split_by_year(monthly):
    train, test = filters.split_by_year(monthly({"a": [(y, 1, y) for y in range(2019, 2026)]}), 2023)
    assert train.count() == 5 and rows(test) == [("a", 2024, 1, 2024)]


def test_null_audit(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert rows(quality.null_audit(df)) == [("a", 1), ("b", 2)]


def test_guards_fail(spark, monthly):
    df = monthly({"a": [(2020, 1, 1)]})
    with pytest.raises(KeyError):
        quality.require_columns(df, ["month"])
    assert quality.require_not_null(df, ["year"]).count() == 1
    bad = monthly({"a": [(None, 1, 1)]})
    with pytest.raises(Exception, match="null in column year"):
        quality.require_not_null(bad, ["year"]).collect()
    with pytest.raises(ValueError):
        quality.require_rows(df.filter("year = 1"))


def test_calendar_violations(spark):
    cells = [("Jan", 2020), ("January", 2020), ("Foo", 2020), (None, 2020), ("Feb", None), ("Mar", 0)]
    df = spark.createDataFrame(cells, "month string, year int")
    assert rows(quality.calendar_violations(df).groupBy("reason").count()) == [
        ("date invalid", 2),
        ("month missing", 1),
        ("month unknown", 2),
    ]
    assert quality.calendar_violations(df, truncate=True).count() == 4


def test_limit(monthly):
    df = monthly({"a": [(2020, 1, 160), (2020, 2, 161)], "b": [(2020, 1, 3)]})
    assert rows(quality.limit_violations(df)) == [("a", 2020, 2, 161)]
    assert quality.peak_month(df).first()[0] == 161


# ---- ranking ----


def test_ties_go_to_the_smallest_name_as_text(monthly):
    same = {n: [(2020, 1, 160)] for n in ["user1", "user2", "user10"]}
    assert ranking.top_user_per_month(monthly(same), "entity").first()["entity"] == "user1"
    del same["user1"]
    assert ranking.top_user_per_month(monthly(same), "entity").first()["entity"] == "user10"


def test_top_k_beyond_the_pruning_limit_is_the_same(spark, monthly):
    rng = random.Random(4)
    df = monthly({f"e{i}": [(2020, m, rng.randint(0, 20)) for m in (1, 2)] for i in range(200)})
    normal = rows(ranking.top_k(df, ["year", "month_num"], "timelog", ["entity"], 17))
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        salted = rows(ranking.top_k(df, ["year", "month_num"], "timelog", ["entity"], 17))
    finally:
        spark.conf.set(key, before)
    assert salted == normal and len(normal) == 34


def test_top_k_prunes_before_the_shuffle(monthly):
    plan = ranking.top_user_per_month(monthly({"a": [(2020, 1, 1)]}), "entity")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_calendar_order(monthly):
    df = ranking.in_calendar_order(monthly({"a": [(2020, m, m) for m in (4, 1, 12, 8)]}))
    assert [r.month_num for r in df.collect()] == [1, 4, 8, 12]


# ---- grids ----


def brute_fill(series, first, last):
    out = []
    for name, points in series.items():
        have = {(y, m): v for y, m, v in points if first <= y <= last}
        if have:
            out += [(name, y, m, have.get((y, m), 0), (y, m) in have) for y in range(first, last + 1) for m in range(1, 13)]
    return sorted(out)


def test_fill_months_against_brute_force(monthly):
    rng = random.Random(5)
    series = {
        f"e{i}": [(y, m, rng.randint(-3, 9)) for y in range(2018, 2023) for m in range(1, 13) if rng.random() < 0.3]
        for i in range(20)
    }
    series["outside"] = [(2017, 5, 1)]
    got = grids.fill_months(monthly(series), "entity", "timelog", 2019, 2021)
    assert rows(got, "entity", "year", "month_num", "timelog", "observed") == brute_fill(series, 2019, 2021)


def test_fill_months_own_range(monthly):
    got = grids.fill_months(monthly({"a": [(2019, 11, 3), (2020, 2, 4)]}), "entity")
    assert rows(got, "year", "month_num", "timelog") == [(2019, 11, 3), (2019, 12, 0), (2020, 1, 0), (2020, 2, 4)]


def test_future_months_anchors(monthly):
    df = monthly({"a": [(2024, 12, 1)], "b": [(2024, 11, 1)]})
    by_obs = grids.future_months(df, "entity", 12, "last_obs").filter("year = 2025")
    assert rows(by_obs.groupBy("entity").count()) == [("a", 12), ("b", 11)]
    by_year = grids.future_months(df, "entity", 12, "year", 2025)
    assert rows(by_year.groupBy("entity").agg(F.min("ds"), F.max("ds"))) == [
        (e, dt.date(2025, 1, 1), dt.date(2025, 12, 1)) for e in "ab"
    ]
    with pytest.raises(ValueError):
        grids.future_months(df, "entity", 12, "year")


def test_day_scaffold_has_leap_days(monthly):
    df = grids.day_scaffold(monthly({"a": [(2020, 1, 1)], "b": [(2020, 1, 1), (2020, 2, 1)]}), "entity", 2020, 2021)
    assert df.count() == 2 * (366 + 365)


# ---- scaling and windows ----


def test_scaling_round_trip_and_constant_series(monthly):
    df = monthly({"a": [(2020, m, m * 3) for m in range(1, 6)], "flat": [(2020, m, 100) for m in range(1, 4)]})
    scaled = scaling.minmax_scale(df, "entity")
    restored = scaled.withColumn("r", scaling.inverse_minmax(F.col("scaled"), F.col("low"), F.col("span")))
    assert restored.filter(F.abs(F.col("r") - F.col("timelog")) > 1e-9).count() == 0
    assert rows(scaled.groupBy("entity").agg(F.min("scaled"), F.max("scaled"))) == [("a", 0.0, 1.0), ("flat", 0.0, 0.0)]
    stats = {r.entity: r for r in scaling.scaling_stats(df, "entity", ["timelog"]).collect()}
    assert stats["flat"].timelog_std == 1.0 and stats["a"].timelog_std == pytest.approx(18**0.5)
    z = scaling.standardise(df, "entity", ["timelog"]).groupBy("entity").agg(F.avg("timelog_z"))
    assert all(abs(r[1]) < 1e-12 for r in z.collect())


def test_lag_windows_and_context(monthly):
    series = {"long": [(2020 + i // 12, i % 12 + 1, i) for i in range(15)], "short": [(2020, m, m) for m in range(1, 13)]}
    df = monthly(series).withColumn("month_idx", F.col("year") * 12 + F.col("month_num") - 1)
    framed = windows.lag_windows(df, "entity", "timelog")
    assert rows(framed, "entity", "target") == [("long", 12), ("long", 13), ("long", 14)]
    assert framed.orderBy("target").first()["lags"] == list(range(12))
    context = {r.entity: r.context for r in windows.last_context(df, "entity", "timelog").collect()}
    assert context == {"long": list(range(3, 15)), "short": list(range(1, 13))}


# ---- apportionment ----


def brute_apportion(data):
    groups = defaultdict(list)
    for g, o, t, w in data:
        groups[g].append((o, t, w))
    out = []
    for g, items in groups.items():
        items.sort()
        total, weights = items[0][1], sum(w for _, _, w in items)
        parts = [round(total * w / weights) if weights else 0 for _, _, w in items]
        parts[0] += total - sum(parts)
        out += [(g, o, p) for (o, _, _), p in zip(items, parts)]
    return sorted(out, key=lambda r: ((r[0] is None), str(r[0]), r[1]))


@pytest.mark.parametrize("path", ["small", "salted"])
def test_apportion_against_brute_force(spark, request, path):
    if path == "salted":
        request.getfixturevalue("no_broadcast")
    rng = random.Random(6)
    data = [("hot", i, 9999, rng.randint(0, 30)) for i in range(600)]
    data += [(f"g{k}", i, rng.randint(0, 1), 1) for k in range(5) for i in range(1)]
    data += [("even", i, 6, 1) for i in range(4)] + [("zero", i, 7, 0) for i in range(3)] + [(None, i, 160, 3) for i in range(3)]
    df = spark.createDataFrame(data, "g string, o int, t long, w long")
    got = apportion.apportion(df, ["g"], "o", "t", "w")
    result = sorted(((r.g, r.o, r.share) for r in got.collect()), key=lambda r: ((r[0] is None), str(r[0]), r[1]))
    assert result == brute_apportion(data)
    assert got.columns == ["g", "o", "t", "w", "share"]


def test_activity_class(monthly):
    df = monthly({"a": [(2020, 1, 160), (2020, 2, 20), (2020, 3, 0), (2020, 4, -2)]})
    assert [r.activity for r in apportion.activity_class(df).orderBy("month_num").collect()] == [
        "full_time",
        "part_time",
        "no_log",
        "no_log",
    ]


# ---- joins and charts ----


def test_align_keeps_both_sides(spark):
    p = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 6.0)], "e string, m int, yhat double")
    a = spark.createDataFrame([("a", 1, 4), ("c", 1, 9)], "e string, m int, timelog long")
    assert rows(joins.align(p, a, ["e", "m"])) == [("a", 1, 5.0, 4.0), ("b", 1, 6.0, None), ("c", 1, None, 9.0)]


def test_group_totals_equal_window_totals(spark, no_broadcast):
    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 10 END AS k", "id AS o", "id % 7 AS v")
    got = joins.with_group_totals(df, ["k"], [F.sum("v").alias("s"), F.count("v").alias("n")], spread=["o"], salts=4)
    expected = df.selectExpr("k", "o", "v", "sum(v) OVER (PARTITION BY k) AS s", "count(v) OVER (PARTITION BY k) AS n")
    assert rows(got) == rows(expected)


def test_chart_tables(spark, monthly):
    totals = spark.createDataFrame([(2020, 1, 5), (2021, 1, 7)], "year int, month_num int, timelog long")
    ahead = spark.createDataFrame([(2022, 1, 8.5)], "year int, month_num int, yhat double")
    assert rows(charts.series_with_forecast(totals, ahead, 2022)) == [
        (1, "Jan", "2020", 5.0),
        (1, "Jan", "2021", 7.0),
        (1, "Jan", "Predicted 2022", 8.5),
    ]
    assert rows(charts.year_month_matrix(totals, [2020, 2021, 2022])) == [(1, 5, 7, None)]
    years = spark.range(2010, 2026).select(charts.block_label(F.col("id"), 2010, 2024).alias("b"))
    assert rows(years.groupBy("b").count()) == [("2010-2014", 5), ("2015-2019", 5), ("2020-2024", 5), (None, 1)]


def test_series_and_predictions_spelling(spark):
    df = spark.createDataFrame([("a", 2020, 2, 5), ("a", None, 3, 6)], "entity string, year int, month_num int, timelog long")
    assert rows(filters.as_series(df, "entity")) == [("a", dt.date(2020, 2, 1), 5)]
    forecast = spark.createDataFrame([("a", 2025, 2, 1.5)], "entity string, year int, month_num int, yhat double")
    assert filters.as_predictions(forecast, "entity").columns == ["entity", "month", "predicted_hours", "year"]


def test_lookup_keeps_unmatched_rows(spark):
    logs = spark.createDataFrame([(1, 5), (2, 7), (None, 1)], "key long, timelog long")
    names = spark.createDataFrame([(1, "one", 10)], "key long, name string, code int")
    got = joins.lookup(logs, names, "key")
    assert rows(got, "name", "code", "timelog") == [(joins.UNMATCHED, None, 1), (joins.UNMATCHED, None, 7), ("one", 10, 5)]
    assert joins.lookup(logs, names, "key", unmatched=None).count() == 1
    assert rows(joins.lookup(logs, names, "key", unmatched="?"), "name") == [("?",), ("?",), ("one",)]


def test_cells_keep_rows_with_one_side(spark):
    data = [("a", 1, "p", 3), ("a", None, None, 7), (None, 1, "p", 11)]
    logs = spark.createDataFrame(data, "username string, projectid int, projectname string, timelog long").selectExpr(
        "*", "2000 AS year", "1 AS month_num"
    )
    cells = rollups.log_cells(logs)
    assert rows(rollups.user_months_with_project(cells), "username", "timelog", "projectid") == [("a", 10, 1.0)]
    assert rows(rollups.monthly_rollup(cells, "projectname"), "projectname", "timelog") == [("p", 14)]


def test_ranks_skip_nan_and_null(spark):
    from tallycast.operators.ranking import top_k

    data = [("g", "a", float("nan")), ("g", "b", 5.0), ("g", "c", None), ("h", "a", float("nan"))]
    df = spark.createDataFrame(data, "k string, name string, v double")
    assert rows(top_k(df, ["k"], "v", ["name"]), "name", "v") == [("b", 5.0)]
    assert rows(top_k(df, ["k"], "v", ["name"], smallest=True), "name", "v") == [("b", 5.0)]
    assert rows(top_k(df, ["k"], "v", ["name"], k=2000), "name", "v") == [("b", 5.0)]
