"""Every operator as a runnable query over the star-schema tables, with its SQL twin."""

from tallycast.workload import data, forecasts, reports

_PARTS = (data, forecasts, reports)


def queries():
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
