from tallycast.streaming.rollup import month_deltas, run_monthly_rollup, stream_logs

__all__ = ["month_deltas", "run_monthly_rollup", "stream_logs"]
