"""Input contracts. CSV files are read with these schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Time logs with month names ('Jan') and a numeric user id.
TEXT_MONTH_LOGS = _schema(
    ("userid", T.LongType()),
    ("username", T.StringType()),
    ("date", T.StringType()),
    ("month", T.StringType()),
    ("year", T.IntegerType()),
    ("projectid", T.IntegerType()),
    ("projectname", T.StringType()),
    ("timelog", T.LongType()),
)

# Time logs with month numbers (1..12) and no user id.
NUMERIC_MONTH_LOGS = _schema(
    ("username", T.StringType()),
    ("date", T.StringType()),
    ("year", T.IntegerType()),
    ("month", T.IntegerType()),
    ("projectid", T.IntegerType()),
    ("projectname", T.StringType()),
    ("timelog", T.LongType()),
)

PROJECTS = _schema(("projectid", T.IntegerType()), ("projectname", T.StringType()))

LOG_LAYOUTS = {"text_month": TEXT_MONTH_LOGS, "numeric_month": NUMERIC_MONTH_LOGS}
