"""Workflow operations on jobs: enqueue, start, complete, fail and cancel, with reasons, errors and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema

#: Operation -> status that it asks for.
TARGETS = {"enqueue": "Queued", "start": "Running", "complete": "Completed", "fail": "Failed", "cancel": "Cancelled"}


def reason(op: Column, detail: Column) -> Column:
    """The reason that a transition is recorded with."""
    said = F.coalesce(detail, F.lit(""))
    return (
        F.when(op == "enqueue", "Enqueued for background processing")
        .when(op == "start", "Worker started execution")
        .when(op == "complete", F.concat(F.lit("Completed with "), F.coalesce(detail, F.lit("0")), F.lit(" findings")))
        .when(op == "fail", F.concat(F.lit("Execution failed: "), said))
        .when(op == "cancel", F.concat(F.lit("Cancelled: "), said))
    )


def workflow(requests: DataFrame) -> DataFrame:
    """Audit rows of requests (job_id, seq, ts, op, detail): adds from_status, to_status, applied, reason and error.

    Requests of a job are taken in order of seq, then ts, then op.  One that is no edge of the job relation changes no
    status, is not persisted (applied = false) and has no reason.  ``fail`` sets the job's error before it is
    validated, so a rejected ``fail`` still shows in ``error``.  An unknown op is never applied.

    Every status is entered at most once, so a fold over numbers of requests is enough: it keeps the places of the
    applied ones, and each row's status follows from its place among them.  Work is linear in a job's requests.
    """
    order = Window.partitionBy("job_id").orderBy("seq", "ts", "op")
    numbered = requests.withColumn("nth", F.row_number().over(order))
    target = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])
    events = F.sort_array(F.collect_list(F.struct("nth", "op")))
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit("Pending").alias("status"), none.alias("queued"), none.alias("running"), none.alias("ended"))
    edges = F.array(*[F.lit(f"{a}>{b}") for a, b in schema.JOB_EDGES])

    def step(a: Column, e: Column) -> Column:
        to = F.try_element_at(target, e["op"])
        good = F.coalesce(F.array_contains(edges, F.concat(a["status"], F.lit(">"), to)), F.lit(False))
        at = lambda old, which: F.when(good & which, e["nth"]).otherwise(old)
        return F.struct(F.when(good, to).otherwise(a["status"]).alias("status"), at(a["queued"], to == "Queued").alias("queued"), at(a["running"], to == "Running").alias("running"), at(a["ended"], to.isin(*schema.TERMINAL)).alias("ended"))

    folded = numbered.groupBy("job_id").agg(F.aggregate(events, zero, step).alias("a")).select(F.col("job_id").alias("j"), "a.*")
    rows = numbered.join(folded, F.col("job_id").eqNullSafe(F.col("j")))
    n = F.col("nth")
    before = F.when(F.col("ended") < n, F.col("status")).when(F.col("running") < n, "Running").when(F.col("queued") < n, "Queued").otherwise("Pending")
    hit = lambda c: F.coalesce(n == F.col(c), F.lit(False))
    applied = hit("queued") | hit("running") | hit("ended")
    failed = F.last(F.when(F.col("op") == "fail", F.coalesce("detail", F.lit(""))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("job_id", "seq", "ts", "op", before.alias("from_status"), F.when(applied, F.try_element_at(target, F.col("op"))).otherwise(before).alias("to_status"), applied.alias("applied"), F.when(applied, reason(F.col("op"), F.col("detail"))).alias("reason"), failed.alias("error"))


def jobs(audit: DataFrame) -> DataFrame:
    """(job_id, status, error, started_at, completed_at, snapshots) after all requests of ``workflow``'s audit rows."""
    last = F.struct("seq", "ts", "op")
    done = F.col("applied")
    return audit.groupBy("job_id").agg(
        F.max_by("to_status", last).alias("status"),
        F.max_by("error", last).alias("error"),
        F.min(F.when(done & (F.col("op") == "start"), F.col("ts"))).alias("started_at"),
        F.min(F.when(done & F.col("to_status").isin(*schema.TERMINAL), F.col("ts"))).alias("completed_at"),
        F.count_if(done).alias("snapshots"),
    )
