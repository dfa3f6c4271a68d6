"""Every registered query against its SQL twin, and what their plans may contain."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as contract
from tallycast import workload
from tools.check_oracle import compare

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"i5_pooled_trees"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_matches_sql(spark, connection, name):
    df = workload.queries()[name](spark, FOLDER)
    assert compare(df, connection, workload.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries(spark, name):
    df = workload.queries()[name](spark, FOLDER)
    assert df.count() == 120
    assert df.filter("yhat IS NULL OR isnan(yhat)").count() == 0


def test_contract(spark):
    assert isinstance(contract.entry(spark), DataFrame)
    assert contract.entry(spark).count() == 12
    own = set(workload.queries())
    assert own - set(workload.oracle_sql()) == ROWS_ONLY
    assert own <= set(contract.queries()) and set(workload.oracle_sql()) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_every_inventory_line_has_a_query():
    """Ids of the operator inventory, by section letter and number."""
    wanted = {
        "a": range(1, 8),
        "b": range(1, 17),
        "c": range(1, 6),
        "d": range(1, 17),
        "e": range(1, 8),
        "f": range(1, 5),
        "g": range(1, 2),
        "h": range(1, 14),
        "i": range(1, 14),
        "j": range(1, 7),
        "k": range(1, 3),
        "m": range(1, 4),
    }
    have = {part for name in workload.queries() for part in re.findall(r"(?:^|_)([a-m]\d+)", name)}
    missing = {f"{s}{n}" for s, numbers in wanted.items() for n in numbers} - have
    assert not missing


# The grouped hook and the stacked moving-average fit (also one of the models compared) are the only Python in any plan.
PYTHON_PLANS = {"k2_grouped_hook", "i6b_seasonal_arma", "i13_compare_models", "i13_best_model_per_user"}


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_plan_has_no_cross_join_or_stray_python(spark, name):
    plan = workload.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = "PythonUDF" in plan or "InPandas" in plan or "ArrowEval" in plan
    assert python == (name in PYTHON_PLANS)
    # A scan never reads columns that no query of this kind uses.
    for read in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "l_comment" not in read and "l_tax" not in read and "l_extendedprice" not in read
