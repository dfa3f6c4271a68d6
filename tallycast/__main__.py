"""Run one analysis: spark-submit -m tallycast, or python -m tallycast --help."""

from __future__ import annotations

import argparse

from tallycast.plans.report import MODELS, run_report
from tallycast.schemas import LOG_LAYOUTS
from tallycast.session import get_session
from tallycast.sources.timelogs import read_timelogs


def main() -> None:
    parser = argparse.ArgumentParser(prog="tallycast")
    parser.add_argument("--logs", required=True, help="folder or file of time logs")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--layout", default="numeric_month", choices=sorted(LOG_LAYOUTS))
    parser.add_argument("--out", required=True, help="base folder of the results")
    parser.add_argument("--run", required=True, help="name of this run")
    parser.add_argument("--model", default="cyclic", choices=sorted(MODELS))
    parser.add_argument("--first-year", type=int, required=True)
    parser.add_argument("--last-year", type=int, required=True)
    parser.add_argument("--backtest", action="store_true")
    parser.add_argument("--output-format", default="csv", choices=["csv", "parquet"])
    args = parser.parse_args()
    spark = get_session()
    logs = read_timelogs(spark, args.logs, args.format, args.layout)
    paths = run_report(
        logs,
        args.out,
        args.run,
        args.model,
        args.first_year,
        args.last_year,
        args.backtest,
        args.output_format,
    )
    for table, path in paths.items():
        print(f"{table}: {path}")


if __name__ == "__main__":
    main()
