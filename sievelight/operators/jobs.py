"""Job state machine, snapshots and windows over their history."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def sm_validate(steps: DataFrame, pairs: tuple[tuple[str, str], ...] = schema.JOB_EDGES) -> DataFrame:
    """``steps`` (from_status, to_status, ...) with ``valid``; the relation is a fixed table of few rows."""
    edge = schema.edges(steps.sparkSession, pairs).withColumn("valid", F.lit(True))
    return steps.join(F.broadcast(edge), ["from_status", "to_status"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def _allowed(state: Column, to: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.array_contains(F.array(*[F.lit(f"{a}>{b}") for a, b in pairs]), F.concat(state, F.lit(">"), to))


def sm_apply(requests: DataFrame, start: str = "Pending", pairs: tuple[tuple[str, str], ...] = schema.JOB_EDGES) -> DataFrame:
    """Replay of each job's requests (job_id, seq, to_status, ts) in order: invalid ones change nothing.

    Gives the final status, started_at, completed_at and the number of applied requests.  Equal seq is ordered by
    time and then status; a job without requests has no row.
    """
    events = F.sort_array(F.collect_list(F.struct("seq", "ts", "to_status")))
    none = F.lit(None).cast("timestamp")
    zero = F.struct(F.lit(start).alias("status"), none.alias("started_at"), none.alias("completed_at"), F.lit(0).alias("applied"))

    def step(acc: Column, e: Column) -> Column:
        good, to = _allowed(acc["status"], e["to_status"], pairs), e["to_status"]
        return F.struct(
            F.when(good, to).otherwise(acc["status"]).alias("status"),
            F.when(good & (to == "Running"), e["ts"]).otherwise(acc["started_at"]).alias("started_at"),
            F.when(good & to.isin(*schema.TERMINAL), e["ts"]).otherwise(acc["completed_at"]).alias("completed_at"),
            (acc["applied"] + F.when(good, 1).otherwise(0)).alias("applied"),
        )

    return requests.groupBy("job_id").agg(F.aggregate(events, zero, step).alias("s")).select("job_id", "s.*")


def win_transition(requests: DataFrame) -> DataFrame:
    """Each request with the status before it and the seconds since then."""
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    return requests.withColumn("from_status", F.lag("to_status").over(w)).withColumn("seconds", (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))).cast("long"))


def latest(snapshots: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key: last write wins."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return snapshots.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def put(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Upsert by key."""
    return store.join(rows, key, "left_anti").unionByName(rows)


def get(store: DataFrame, key: str, value: object) -> DataFrame:
    return store.where(F.col(key) == F.lit(value))


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys, key, "left_anti")


def alive(store: DataFrame, written: str, ttl_seconds: int, now: Column) -> DataFrame:
    """Entries younger than the time to live."""
    return store.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(written)) < ttl_seconds)


def read_through(l1: DataFrame, l2: DataFrame, key: str, value: str) -> DataFrame:
    """Two-tier lookup: the first tier's value, otherwise the second's, with the tier it came from."""
    a, b = l1.select(key, F.col(value).alias("v1")), l2.select(key, F.col(value).alias("v2"))
    return a.join(b, key, "full").select(key, F.coalesce("v1", "v2").alias(value), F.when(F.col("v1").isNotNull(), 1).otherwise(2).alias("tier"))


def list_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    """The objects (key, ...) of a listing below ``prefix``; keys that end in "/" are folders and skipped."""
    return objects.where(F.col("key").startswith(prefix) & ~F.col("key").endswith("/"))


def win_cap(objects: DataFrame, group: str, max_objects: int, max_bytes: int) -> DataFrame:
    """The objects that a capped listing takes of each group, in key order.

    Listing stops once a cap is reached; an object that would overflow is skipped, and later smaller ones may fit.
    One pass over a group's sizes, which are held by one task; groups run in parallel.
    """
    kind = f"{group} {dict(objects.dtypes)[group]}, key string, size long"

    def take(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("size", "ascending")])
        kept, held = [], 0
        for k, size in enumerate(rows["size"].to_pylist()):
            if len(kept) == max_objects:
                break
            if held + size <= max_bytes:
                kept.append(k)
                held += size
        return rows.take(pa.array(kept, pa.int64()))

    return objects.select(group, "key", F.col("size").cast("long").alias("size")).where("size IS NOT NULL").groupBy(group).applyInArrow(take, kind)


def shard_lpt(files: DataFrame, group: str, max_shards: int) -> DataFrame:
    """Balanced shards of each group: by size descending and path by component, each file to the lightest shard.

    Ties go to the lowest shard.  A heap over the shards' loads, in one task a group; no shards, no rows.
    """
    out = f"{group} {dict(files.dtypes)[group]}, shard int, path string, size long"
    if max_shards <= 0:
        return files.sparkSession.createDataFrame([], out)

    def place(rows: pa.Table) -> pa.Table:
        size, path = rows["size"].to_pylist(), rows["path"].to_pylist()
        loads = [(0, k) for k in range(min(len(size), max_shards))]
        to = [0] * len(size)
        for k in sorted(range(len(size)), key=lambda k: (-size[k], path[k].split("/"))):
            load, shard = heapq.heappop(loads)
            to[k] = shard
            heapq.heappush(loads, (load + size[k], shard))
        return pa.table([rows[group], pa.array(to, pa.int32()), rows["path"], rows["size"]], names=[group, "shard", "path", "size"])

    return files.select(group, "path", F.col("size").cast("long").alias("size")).groupBy(group).applyInArrow(place, out)
