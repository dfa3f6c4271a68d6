from tallycast.sources.results import read_result, read_run_table, read_runs, write_result, write_run
from tallycast.sources.star import project_logs, user_logs
from tallycast.sources.timelogs import read_projects, read_timelogs, write_projects, write_timelogs

__all__ = [
    "project_logs",
    "read_projects",
    "read_result",
    "read_run_table",
    "read_runs",
    "read_timelogs",
    "user_logs",
    "write_projects",
    "write_result",
    "write_run",
    "write_timelogs",
]
