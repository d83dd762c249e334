"""A table run as a stream in ranges of its order."""

from quillon.plans.streams import run_available
from quillon.streaming.replay import fcfs_stream


def test_ranges_follow_one_another_with_their_state(spark):
    rows = [(f"q{i % 2}", i, float((i * 7) % 40), 3.0) for i in range(60)]
    jobs = spark.createDataFrame(rows, "queue string, job_id long, arrival_s double, service_s double")
    seen = []
    plan = lambda s: seen.append(1) or fcfs_stream(s)
    got = sorted(tuple(r) for r in run_available(spark, jobs, plan, ["arrival_s", "job_id"], 20).collect())
    want, free = [], {}
    for queue, job, arrival, service in sorted(rows, key=lambda r: (r[2], r[1])):
        begin = max(arrival, free.get(queue, 0.0))
        free[queue] = begin + service
        want.append((queue, job, arrival, begin, begin - arrival, begin + service, False))
    assert got == sorted(want) and len(seen) == 3
