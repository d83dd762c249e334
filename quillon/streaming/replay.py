"""A first-come-first-served queue over a stream, state kept per queue.

The state of a queue is the time its server is free.  Rows of a micro-batch are
taken in (arrival, id) order; a row that arrives before one already served is
late and goes out flagged, without changing the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "queue string, job_id long, arrival_s double, begin_s double, wait_s double, end_s double, late boolean"
STATE = "free double, last double"


def fcfs_stream(jobs: DataFrame) -> DataFrame:
    """jobs (streaming): queue string, job_id long, arrival_s double, service_s double."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, last = state.get if state.exists else (0.0, float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["arrival_s", "job_id"], kind="stable")
        out = []
        for job, arrival, service in zip(rows.job_id, rows.arrival_s, rows.service_s):
            if arrival < last:
                out.append((key[0], job, arrival, None, None, None, True))
                continue
            begin = max(arrival, free)
            free, last = begin + service, arrival
            out.append((key[0], job, arrival, begin, begin - arrival, free, False))
        state.update((free, last))
        yield pd.DataFrame(out, columns=["queue", "job_id", "arrival_s", "begin_s", "wait_s", "end_s", "late"]).astype({c: "float64" for c in ("arrival_s", "begin_s", "wait_s", "end_s")})

    return jobs.groupBy("queue").applyInPandasWithState(serve, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_profile(events: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts and mean per tumbling window with a watermark for late rows (time must be a timestamp)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
