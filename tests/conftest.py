from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallycast.session import get_session  # noqa: E402

MONTHLY = "entity string, year int, month_num int, timelog long"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def monthly(spark):
    """Build a monthly table from {entity: [(year, month, value), ...]}."""

    def build(series: dict, schema: str = MONTHLY):
        rows = [(name, *row) for name, points in series.items() for row in points]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def no_broadcast(spark):
    """Force the paths taken beyond the broadcast limit."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def rows(df, *order):
    """Collected tuples, sorted by the given columns (or all)."""
    out = [tuple(r) for r in df.select(*order).collect()] if order else [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))
