"""Python workers must not need the package on their path."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("k2_grouped_hook", "i6b_seasonal_arma"):
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")
def test_python_plans_run_from_another_folder(spark, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT, FOLDER], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split() == ["k2_grouped_hook", "120", "i6b_seasonal_arma", "120"]
