import datetime as dt
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql.streaming.query import StreamingQuery

from sievelight import schema
from sievelight.plans.registry import QUERIES
from sievelight.streaming import jobs as ST


@pytest.mark.parametrize("name,table", [("src_queue", "orders"), ("stream_rate_limit", "events")])
def test_no_result_before_the_stream_has_ended(spark, small, monkeypatch, name, table):
    """A wait with a limit is taken as one that runs out at once."""
    wait, ended = StreamingQuery.awaitTermination, []

    def limited(self, timeout=None):
        if timeout is not None:
            return False
        wait(self)
        ended.append(not self.isActive)

    monkeypatch.setattr(StreamingQuery, "awaitTermination", limited)
    rows = QUERIES[name](spark, small).count()
    assert ended == [True] and rows > 0
    if name == "src_queue":
        assert rows == spark.read.parquet(f"{small}/{table}.parquet").count()


def _state():
    """A state that does what Spark's does, at a time that the test sets."""

    class State:
        exists, hasTimedOut, get, ends, now = False, False, None, None, 0

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            assert ms > 0
            self.ends = self.now + ms

        def remove(self):
            self.exists, self.get, self.ends = False, None, None

        def getCurrentProcessingTimeMs(self):
            return self.now

    return State()


def test_a_bucket_of_jobs_takes_each_job_as_if_it_were_alone():
    """Batches at random times, so that some jobs of the bucket time out and others go on."""
    rng, ttl, kind = random.Random(7), 1000, ["job_id", "seq", "to_status", "ts"]
    both, one = ST.bucket_step(ttl), ST.lifecycle_step(ttl)
    whole, alone, now, dropped, applied = _state(), defaultdict(_state), 0, 0, 0
    for _ in range(200):
        now += rng.randint(1, 700)
        jobs = rng.sample(range(9), rng.randint(0, 4))
        rows = [(j, rng.randint(0, 6), rng.choice([*schema.STATUSES, "odd", None]), pd.Timestamp(now, unit="ms")) for j in jobs for _ in range(rng.randint(1, 5))]
        rng.shuffle(rows)
        want = []
        for j in range(9):
            s, own = alone[j], [r for r in rows if r[0] == j]
            s.now, s.hasTimedOut = now, not own and s.ends is not None and s.ends < now
            if own or s.hasTimedOut:
                dropped += s.hasTimedOut
                s.ends = None
                want += [tuple(r) for f in one((j,), iter([pd.DataFrame(own, columns=kind)]), s) for r in f.itertuples(index=False)]
        whole.now, whole.hasTimedOut = now, not rows and whole.ends is not None and whole.ends < now
        got = []
        if rows or whole.hasTimedOut:
            cuts = [pd.DataFrame(rows[:3], columns=kind), pd.DataFrame(rows[3:], columns=kind)] if len(rows) > 3 else [pd.DataFrame(rows, columns=kind)]
            got = [tuple(r) for f in both((0, False), iter(cuts), whole) for r in f.itertuples(index=False)]
        by = lambda r: r[0]
        assert sorted(got, key=by) == sorted(want, key=by)
        applied += sum(r[4] for r in got)
        left = [j for j in range(9) if alone[j].exists]
        assert whole.exists == bool(left) and (not left or len(whole.get[0]) // 8 <= len(left))
    assert dropped > 20 and applied > 50


def test_lifecycle_calls_python_by_bucket_and_keeps_all_batches(spark, tmp_path):
    """5,000 jobs, ids beyond 2 ** 53 and one without, in two batches: their state goes from one to the next."""
    first = [(j, 1, "Queued") for j in range(5000)] + [(2**60 + 1, 1, "Queued"), (2**60 + 2, 1, "Running"), (None, 1, "Queued")]
    second = [(j, 2, "Running" if j % 2 else "Failed") for j in range(5000)] + [(2**60 + 1, 2, "Running"), (2**60 + 2, 2, "Running"), (None, 2, "Running"), (None, None, "Failed")]
    kind = "job_id long, seq int, to_status string, ts timestamp"
    for rows in (first, second):
        spark.createDataFrame([(*r, dt.datetime(2024, 1, 1)) for r in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        stream = ST.lifecycle(ST.queue(spark, f"{tmp_path}/in", kind, 1), buckets=16)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    done = [p for p in q.recentProgress if p.numInputRows]
    assert len(done) == 2 and max(p.stateOperators[0].numRowsTotal for p in done) <= 17
    got = {(r.job_id, r.seq): (r.from_status, r.applied) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(first) + len(second)
    for j in range(5000):
        assert got[j, 1] == ("Pending", True) and got[j, 2] == ("Queued", j % 2 == 1)
    assert got[2**60 + 1, 2] == ("Queued", True) and got[2**60 + 2, 2] == ("Pending", False)
    assert got[None, 1] == ("Pending", True) and got[None, 2] == ("Queued", True) and got[None, None] == ("Running", False)
