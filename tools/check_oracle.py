"""Run queries and their SQL twins side by side.

python tools/check_oracle.py FOLDER [PREFIX...] [key=value...]

A key=value argument sets a Spark setting, e.g. spark.sql.autoBroadcastJoinThreshold=-1
to take the paths beyond the broadcast limit.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallycast import workload  # noqa: E402
from tallycast.session import get_session  # noqa: E402

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(df, connection, sql):
    """None when equal, else a description of the difference. Values are compared exactly."""
    names = sorted(df.columns)
    ours = df.select(*[f"`{n}`" for n in names])
    theirs = connection.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    if sorted(df.columns) != sorted(connection.sql(sql).columns):
        return f"columns {sorted(df.columns)} / {sorted(connection.sql(sql).columns)}"
    kinds = [(n, t, str(k)) for (n, t), k in zip(ours.dtypes, theirs.types) if _TYPES.get(t, t) != str(k)]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    left = sorted((tuple(r) for r in ours.collect()), key=key)
    right = sorted(theirs.fetchall(), key=key)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; types {kinds}"
    wrong = [(a, b) for a, b in zip(left, right) if key(a) != key(b) and a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}; types {kinds}"
    if any(str(v) == "-0.0" for r in left + right for v in r):
        return "negative zero"
    return f"types {kinds}" if kinds else None


def main() -> int:
    folder, rest = sys.argv[1], sys.argv[2:]
    prefixes = tuple(a for a in rest if "=" not in a)
    spark = get_session("check", master="local[8]", shuffle_partitions=8)
    for setting in (a for a in rest if "=" in a):
        spark.conf.set(*setting.split("=", 1))
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    oracle, bad = workload.oracle_sql(), 0
    for name, run in workload.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracle:
                problem = compare(df, connection, oracle[name])
            else:
                problem = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem) and not problem.startswith("rows only")
        print(f"{'ok  ' if not problem else '    '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
