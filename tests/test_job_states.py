"""The job state machine: plain loops, batch and stream give the same, and a restart goes on where it stopped."""

import datetime as dt
import random

import pytest

from strandlake.operators import jobs
from strandlake.streaming import job_log, job_states

START, TIMEOUT = dt.datetime(2024, 1, 1), 5_000


def events(seed=3, n=300):
    rng = random.Random(seed)
    kinds = ["start", "running", "running", "running", "end", "error"]
    rows = [(rng.randrange(12), i, START + dt.timedelta(milliseconds=rng.randrange(60_000)), "job", rng.choice(kinds), {}) for i in range(n)]
    return rows + [(20, 1000 + i, START + dt.timedelta(milliseconds=7 * (i // 3)), "job", "start" if not i else "running", {}) for i in range(200)]  # a hot job


def loops(rows, until):
    out, by_job = set(), {}
    for job, event, ts, _, status, _ in rows:
        by_job.setdefault(job, []).append((round((ts - START).total_seconds() * 1000), event, status))
    for job, mine in by_job.items():
        state, last = None, 0
        for ms, event, said in [*sorted(mine), (until, None, None)]:
            if state in ("submitted", "running") and ms > last + TIMEOUT:
                state = "timeout"
                out.add((job, None, "timeout", "timeout"))
            if event is None:
                continue
            if state is None:
                outcome, state = ("accepted", "submitted") if said == "start" else ("early", None)
            elif said == "start":
                outcome = "repeated"
            elif state not in ("submitted", "running"):
                outcome = "closed"
            else:
                outcome, state = "accepted", {"end": "done", "error": "error"}.get(said, "running")
            last = ms if outcome == "accepted" else last
            out.add((job, event, outcome, state))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_against_loops(spark, seed):
    rows = events(seed)
    until = 90_000
    base = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    got = jobs.transitions(spark.createDataFrame(rows, job_log.EVENT_SCHEMA), TIMEOUT, base + until).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == loops(rows, until)


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """Three files of shuffled events and two far later, read by several runs on one checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", job_states.PROVIDER)
    rows, folder = events(), str(tmp_path / "in")
    far = lambda n: [(99, 5000 + n, START + dt.timedelta(seconds=400 + n), "job", "running", {})]

    def put(part):
        spark.createDataFrame(part, job_log.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = job_states.transitions(job_log.read_events(spark, folder), TIMEOUT, "70 seconds")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    random.Random(1).shuffle(rows)
    put(rows[:200])
    put(rows[200:350])
    run()
    put(rows[350:])
    run()
    put(far(0))
    run()
    put(far(1))  # deadlines set behind the watermark fall due in the next micro-batch
    run()
    got = [tuple(r) for r in spark.read.schema(job_states.OUTCOMES).parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and {r for r in got if r[0] != 99} == loops(rows, 300_000)
