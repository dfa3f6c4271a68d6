from __future__ import annotations

import datetime as dt

import pytest

from tallycast.sources import results, timelogs
from tallycast.storage import materialise, scratch_path
from tests.conftest import rows

NUMERIC = "username,date,year,month,projectid,projectname,timelog\n"
TEXT = "userid,username,date,month,year,projectid,projectname,timelog\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_numeric_layout(spark, tmp_path):
    path = write(tmp_path / "a.csv", NUMERIC + "user1,2020-02-03,2020,2,1,Project Alpha,-4\n")
    logs = timelogs.read_timelogs(spark, path)
    row = logs.first()
    assert row.date == dt.date(2020, 2, 3) and row.month_num == 2 and row.timelog == -4
    assert dict(logs.dtypes)["date"] == "date"


def test_text_layout(spark, tmp_path):
    path = write(tmp_path / "a.csv", TEXT + "7,Ann,2020-12-31,Dec,2020,1,Project Alpha,55\n")
    row = timelogs.read_timelogs(spark, path, layout="text_month").first()
    assert (row.username, row.month_num, row.timelog) == ("Ann", 12, 55)


def test_wrong_header_fails(spark, tmp_path):
    path = write(tmp_path / "a.csv", TEXT + "7,Ann,2020-12-31,Dec,2020,1,Project Alpha,55\n")
    with pytest.raises(Exception):
        timelogs.read_timelogs(spark, path, layout="numeric_month").collect()


@pytest.mark.parametrize("cells", ["u,2020-13-03,2020,2,1,P,4", "u,hello,2020,2,1,P,4", "u,2020-02-03,2020,2,1,P,x"])
def test_bad_cells_fail(spark, tmp_path, cells):
    path = write(tmp_path / "a.csv", NUMERIC + cells + "\n")
    with pytest.raises(Exception):
        timelogs.read_timelogs(spark, path).collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
@pytest.mark.parametrize("layout", ["numeric_month", "text_month"])
def test_log_round_trip(spark, tmp_path, fmt, layout):
    source = write(tmp_path / "a.csv", NUMERIC + "user1,2020-02-03,2020,2,1,Alpha,4\nuser2,2021-11-30,2021,11,2,Beta,0\n")
    logs = timelogs.read_timelogs(spark, source)
    path = str(tmp_path / "out")
    timelogs.write_timelogs(logs, path, fmt, layout)
    again = timelogs.read_timelogs(spark, path, fmt, layout)
    assert rows(again, *sorted(again.columns)) == rows(logs, *sorted(logs.columns))


def test_projects_round_trip(spark, tmp_path):
    projects = spark.createDataFrame([(1, "Alpha"), (2, "Beta, the second")], "projectid int, projectname string")
    timelogs.write_projects(projects, str(tmp_path / "p"))
    assert rows(timelogs.read_projects(spark, str(tmp_path / "p"))) == rows(projects)


def test_results_by_model_and_run(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, v double")
    base = str(tmp_path)
    path = results.write_result(df, base, "m1", "r1", "t", single_file=True)
    assert path.endswith("model=m1/run=r1/t")
    assert len(list((tmp_path / "model=m1" / "run=r1" / "t").glob("*.csv"))) == 1
    results.write_result(df.limit(1), base, "m2", "r1", "t")
    assert rows(results.read_result(spark, base, "m1", "r1", "t", df.schema)) == rows(df)
    runs = results.read_runs(spark, base, "t", df.schema)
    assert rows(runs.groupBy("model", "run").count()) == [("m1", "r1", 2), ("m2", "r1", 1)]


def test_writing_again_replaces_the_run(spark, tmp_path):
    df = spark.range(5)
    for n in (5, 3):
        results.write_result(df.limit(n), str(tmp_path), "m", "r", "t", "parquet")
    assert results.read_result(spark, str(tmp_path), "m", "r", "t", df.schema, "parquet").count() == 3


def test_materialise_keeps_rows_and_cuts_lineage(spark):
    kept = materialise(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 7 and "Range" not in plan
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    from tallycast.streaming import rollup

    logs = spark.range(600).selectExpr("id % 5 AS partkey", "2000 AS year", "CAST(1 + id % 12 AS INT) AS month_num", "id AS timelog")
    logs.repartition(4).write.parquet(str(tmp_path / "logs.parquet"))
    stream = rollup.stream_logs(spark, str(tmp_path / "logs.parquet"), logs.schema)
    rollup.run_monthly_rollup(stream, "partkey", str(tmp_path / "out"))
    got = rollup.month_deltas(spark, "partkey", str(tmp_path / "out"))
    assert got.count() == 60 and got.agg({"timelog": "sum"}).first()[0] == 600 * 599 // 2


def test_read_runs_fails_on_bad_cells_and_headers(spark, tmp_path):
    import pytest

    from tallycast.sources import results

    base = str(tmp_path / "base")
    results.write_result(spark.createDataFrame([("A", "7"), ("B", "notanumber")], "name string, v string"), base, "m", "r", "t")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        results.read_runs(spark, base, "t", spark.createDataFrame([], "name string, v int").schema).collect()
    with pytest.raises(Exception):  # noqa: B017
        results.read_runs(spark, base, "t", spark.createDataFrame([], "other string, v string").schema).collect()


def test_fractions_are_kept_or_refused(spark):
    import pytest

    from tallycast.sources.star import as_line_logs

    lines = spark.sql("SELECT 1L AS l_suppkey, 2L AS l_partkey, 0.75D AS l_quantity, TIMESTAMP_NTZ'2000-01-02' AS l_shipdate")
    assert as_line_logs(lines, whole_hours=False).first().timelog == 0.75
    with pytest.raises(Exception, match="no whole number"):
        as_line_logs(lines).collect()
    assert as_line_logs(lines.selectExpr("* EXCEPT (l_quantity)", "CAST(NULL AS DOUBLE) AS l_quantity")).first().timelog is None


def test_kept_tables_lie_in_the_named_folder_and_take_filters(spark):
    from tallycast.storage import drop_scratch, shared_folder

    path = scratch_path(spark, "x")
    assert path.startswith(shared_folder(spark))
    spark.range(10).write.parquet(path)
    drop_scratch(spark, path)
    kept = materialise(spark.range(100).selectExpr("id % 7 AS year", "id AS v")).filter("year > 3").select("year")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(year,3)" in plan and "ReadSchema: struct<year:bigint>" in plan


def test_deltas_fold_into_bounded_folders_and_any_batch_may_be_replayed(spark, tmp_path):
    from tallycast.operators.rollups import monthly_rollup
    from tallycast.streaming import month_deltas, rollup

    out = str(tmp_path)
    logs = spark.range(900).selectExpr("id % 3 AS k", "2000 AS year", "CAST(1 + id % 12 AS INT) AS month_num", "id AS timelog", "CAST(id % 30 AS INT) AS b")
    logs = materialise(logs)
    for number in range(30):
        batch = logs.where(f"b = {number}").drop("b")
        for _ in range(2 if number % 4 in (0, 3) else 1):  # a batch that folds, and the one after, come twice
            rollup.write_batch(batch, number, "k", out, fold=4)
        if number in (2, 7, 12):
            so_far = monthly_rollup(logs.where(f"b <= {number}"), "k")
            assert rows(month_deltas(spark, "k", out)) == rows(so_far)
        assert len(list(tmp_path.glob("deltas/batch=*"))) <= 8 and len(list(tmp_path.glob("folds/upto=*"))) <= 2
    # a fold that broke off before its end is not read
    (tmp_path / "folds" / "upto=29").mkdir()
    assert rows(month_deltas(spark, "k", out)) == rows(monthly_rollup(logs, "k"))


@pytest.mark.parametrize("name", ["in{a}", "in[b]", "in*", "a?b", "a\\b"])
def test_stream_refuses_pattern_characters_in_a_path(spark, name):
    from tallycast.streaming import stream_logs

    with pytest.raises(ValueError, match="pattern characters"):
        stream_logs(spark, f"/data/{name}/", spark.range(1).schema)


def test_a_run_replaces_itself_only_and_reads_prune(spark, tmp_path):
    table = str(tmp_path / "totals")
    schema = "name string, v long"
    results.write_run(spark.createDataFrame([("a", 1), ("b", 2)], schema), table, "m1", "2024")
    results.write_run(spark.createDataFrame([("a", 3)], schema), table, "m1", "2025")
    results.write_run(spark.createDataFrame([("a", 4)], schema), table, "m2", "2025")
    results.write_run(spark.createDataFrame([("c", 5)], schema), table, "m1", "2024")
    read = results.read_run_table(spark, table, spark.createDataFrame([], schema).schema)
    assert rows(read) == [("a", 3, "m1", "2025"), ("a", 4, "m2", "2025"), ("c", 5, "m1", "2024")]
    one = read.where("model = 'm1' AND run = '2025'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and one.count() == 1
    with pytest.raises(ValueError, match="no rows"):
        results.write_run(spark.createDataFrame([], schema), table, "m3", "2025")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_logs_by_year_prune_folders(spark, tmp_path, fmt):
    from tallycast.operators.filters import year_between

    text = NUMERIC + "".join(f"user{i},{y}-02-03,{y},2,1,Alpha,{i}\n" for i, y in enumerate((2019, 2020, 2021, 2021)))
    logs = timelogs.read_timelogs(spark, write(tmp_path / "a.csv", text))
    path = str(tmp_path / "out")
    timelogs.write_timelogs(logs, path, fmt, by_year=True)
    again = timelogs.read_timelogs(spark, path, fmt)
    assert rows(again, *sorted(again.columns)) == rows(logs, *sorted(logs.columns))
    late = year_between(again, 2020, 2021)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and late.count() == 3
