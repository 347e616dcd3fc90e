"""Structured Streaming: job queue, lifecycle, rate limits, event retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema

LIFECYCLE = "job_id long, seq int, from_status string, to_status string, applied boolean, ts timestamp"
#: The state of the jobs of a bucket, an array of numbers each: job_id, place in ``schema.STATUSES``, last applied seq, end of its life in ms.
STATE = "job binary, status binary, last_seq binary, until binary"
TTL_MS = 7_200_000
BUCKETS = 1024


def queue(spark: SparkSession, folder: str, kind: T.StructType | str, most: int = 8) -> DataFrame:
    """The job queue: files of a folder, at most ``most`` a batch, which bounds the jobs in flight."""
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", most).parquet(folder)


def work(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feed each batch to ``handle``; delivery is at least once, so ``handle`` must be idempotent by job_id."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lifecycle(requests: DataFrame, ttl_ms: int = TTL_MS, buckets: int = BUCKETS) -> DataFrame:
    """Apply status requests (job_id, seq, to_status, ts) to each job's state.

    A request that is no edge, or whose seq is not beyond the last applied one, changes nothing and is reported with
    applied = false.  State that sees nothing for ``ttl_ms`` is dropped.

    A call of a state function costs milliseconds however few rows it has, so that jobs share one by the hash of their
    id: a batch takes at most ``buckets`` calls for all its jobs, and one for requests without a job_id.
    """
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    job = F.coalesce(F.col("job_id").cast("long"), F.lit(0).cast("long"))  # pandas has no long column with nulls
    keyed = requests.select(bucket.alias("bucket"), F.col("job_id").isNull().alias("unnamed"), job.alias("job_id"), "seq", "to_status", "ts")
    return keyed.groupBy("bucket", "unnamed").applyInPandasWithState(bucket_step(ttl_ms), LIFECYCLE, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def bucket_step(ttl_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state function of ``lifecycle``: ``lifecycle_step`` for all jobs of a bucket, each with an end of life of its own."""
    allowed, names = set(schema.JOB_EDGES), schema.STATUSES
    code = {name: k for k, name in enumerate(names)}
    kinds = ("<i8", "<i1", "<i8", "<i8")

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentProcessingTimeMs(), {}
        if state.exists:
            jobs, codes, lasts, ends = [np.frombuffer(b, kind).tolist() for b, kind in zip(state.get, kinds, strict=True)]
            held = dict(zip(jobs, zip([names[c] for c in codes], lasts, ends, strict=True), strict=True))
        out = None
        if not state.hasTimedOut:
            rows = pd.concat(list(pdfs)).sort_values("seq", kind="stable")
            before, good = [], []
            for job, seq, to in zip(rows["job_id"].tolist(), rows["seq"].tolist(), rows["to_status"].tolist(), strict=True):
                status, last, _ = held.get(job, ("Pending", 0, 0))
                before.append(status)
                good.append((status, to) in allowed and seq > last)
                held[job] = (to, int(seq), now + ttl_ms) if good[-1] else (status, last, now + ttl_ms)
            out = pd.DataFrame({"job_id": None if key[1] else rows["job_id"], "seq": rows["seq"], "from_status": before, "to_status": rows["to_status"], "applied": good, "ts": rows["ts"]})
        held = {job: v for job, v in held.items() if v[2] >= now}
        if held:
            status, last, end = zip(*held.values(), strict=True)
            state.update(tuple(np.array(v, kind).tobytes() for v, kind in zip((list(held), [code[s] for s in status], last, end), kinds, strict=True)))
            state.setTimeoutDuration(max(1, min(end) - now))
        else:
            state.remove()
        if out is not None:
            yield out

    return step


def lifecycle_step(ttl_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state function of a single job, with state (status, last_seq): what ``bucket_step`` must give for each of its jobs."""
    allowed = set(schema.JOB_EDGES)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, last = state.get if state.exists else ("Pending", 0)
        rows = pd.concat(list(pdfs)).sort_values("seq", kind="stable")
        before, good = [], []
        for seq, to in zip(rows["seq"].tolist(), rows["to_status"].tolist(), strict=True):
            before.append(status)
            good.append((status, to) in allowed and seq > last)
            if good[-1]:
                status, last = to, seq
        state.update((status, int(last)))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"job_id": key[0], "seq": rows["seq"], "from_status": before, "to_status": rows["to_status"], "applied": good, "ts": rows["ts"]})

    return step


COSTS = {"view": 1, "click": 1, "signup": 2, "purchase": 3, "error": 6}


def cost(column: str = "event_type") -> Column:
    out = F.lit(1)
    for name, c in COSTS.items():
        out = F.when(F.col(column) == name, c).otherwise(out)
    return out


def rate_limit(events: DataFrame, limit: int, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Cost by user and window, and whether it is over the limit; works on a table and on a stream (late events go)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = timed.groupBy("user_id", w.alias("w")).agg(F.sum(cost()).alias("cost"))
    return g.select("user_id", F.col("w.start").alias("start"), "cost", (F.col("cost") > limit).alias("limited"))


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """(user_id, event_id, allowed): exact token bucket, one pass over a user's events in order of time and id;
    ``allowed`` says whether the bucket held the event's cost."""
    kind = f"user_id {dict(events.dtypes)['user_id']}, event_id long, allowed boolean"

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("us", "ascending"), ("event_id", "ascending")])
        tokens, last, out = float(capacity), None, []
        for us, price in zip(rows["us"].to_pylist(), rows["cost"].to_pylist(), strict=True):
            tokens = min(float(capacity), tokens + ((us - last) / 1e6 if last is not None else 0.0) * per_second)
            out.append(tokens >= price)
            tokens -= price if out[-1] else 0.0
            last = us
        return pa.table([rows["user_id"], rows["event_id"], pa.array(out, pa.bool_())], names=["user_id", "event_id", "allowed"])

    timed = events.select("user_id", F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), cost().cast("double").alias("cost"))
    return timed.groupBy("user_id").applyInArrow(run, kind)


#: (requests a minute, requests an hour, burst) by kind of caller.
TIERS = {"api_key": (100, 2000, 20), "authenticated": (60, 1000, 10), "anonymous": (10, 100, 5)}
ORG_BONUS_PERCENT = 20


def tier_limits(callers: DataFrame) -> DataFrame:
    """``callers`` (caller, is_member, ...) with per_minute, per_hour and burst; members of an organization get
    ``ORG_BONUS_PERCENT`` more, rounded down.  An unknown caller counts as anonymous."""
    def of(k: int) -> Column:
        base = F.lit(TIERS["anonymous"][k])
        for name, limits in TIERS.items():
            base = F.when(F.col("caller") == name, limits[k]).otherwise(base)
        return F.when(F.coalesce("is_member", F.lit(False)), F.floor(base * (100 + ORG_BONUS_PERCENT) / 100)).otherwise(base).cast("int")

    return callers.withColumns({"per_minute": of(0), "per_hour": of(1), "burst": of(2)})


def lockout(attempts: DataFrame, key: str, per_minute: int = 5, per_hour: int = 20, minutes: int = 15) -> DataFrame:
    """``attempts`` (key, ts, ...) with over and locked: sliding windows over the key's own attempts.

    ``over``: this attempt and those of the 60 seconds (3,600) before it are more than ``per_minute`` (``per_hour``).
    ``locked``: an attempt in the ``minutes`` before this one was over.
    """
    w = Window.partitionBy(key).orderBy("sec")
    timed = attempts.withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    within = lambda s: F.count("*").over(w.rangeBetween(-s + 1, 0))
    judged = timed.withColumn("over", (within(60) > per_minute) | (within(3600) > per_hour))
    locked = F.coalesce(F.max("over").over(w.rangeBetween(-60 * minutes, -1)), F.lit(False))
    return judged.withColumn("locked", locked).drop("sec")


def retain(events: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """Events of the last ``days`` days; on a table partitioned by date this prunes partitions."""
    return events.where(F.col("ts") >= F.date_sub(now, days))
