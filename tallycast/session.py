"""Session helper for scripts and tests; library code always takes the caller's session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(
    app: str = "tallycast",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A UTC session with adaptive execution on.

    Leave ``master`` and ``shuffle_partitions`` unset on a cluster: the submit
    command names the master, and adaptive execution merges small partitions
    down from the configured number, so that number should be high there
    (about total shuffle bytes / 128 MB).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
