"""Organizations: inherited limits, monthly statistics, quotas, referential actions, usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

MAX_DEPTH = 10


def hier_limits(orgs: DataFrame, limits: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, organization_id, tier, max_scans_monthly, max_api_calls_monthly): effective limits of each organization.

    Walks up the parents while inherit_limits holds and fewer than ``max_depth`` steps were made.  A missing limits
    row anywhere on the way gives nulls; without a parent the own limits hold.  Each step is one equi-join that moves
    every organization to its parent or leaves it where it is, so the plan has ``max_depth`` joins, and cycles end too.
    """
    fields = ["tier", "max_scans_monthly", "max_api_calls_monthly"]
    up = orgs.select(F.col("id").alias("at"), F.col("parent_id").alias("up"))
    move = limits.where("inherit_limits").select(F.col("organization_id").alias("at")).join(up.where("up IS NOT NULL"), "at")
    now = orgs.select("id", F.col("id").alias("at"))
    for _ in range(max_depth):
        now = now.join(move, "at", "left").select("id", F.coalesce("up", "at").alias("at"))
    own = limits.select(F.col("organization_id").alias("at"), "organization_id", *fields)
    return now.join(own, "at", "left").select("id", "organization_id", *fields)


def view_effective(orgs: DataFrame, limits: DataFrame) -> DataFrame:
    e = hier_limits(orgs, limits)
    return orgs.join(e, "id", "left").select("id", "name", "parent_id", F.coalesce("tier", F.lit("free")).alias("effective_tier"), F.coalesce("max_scans_monthly", F.lit(5)).alias("effective_max_scans_monthly"), F.coalesce("max_api_calls_monthly", F.lit(1000)).alias("effective_max_api_calls_monthly"))


def insert_default_limits(orgs: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` and a free row for each organization without one."""
    new = orgs.join(limits, orgs["id"] == limits["organization_id"], "left_anti").select(F.col("id").alias("organization_id"), F.lit("free").alias("tier"), F.lit(5).alias("max_scans_monthly"), F.lit(1000).alias("max_api_calls_monthly"), F.lit(False).alias("inherit_limits"))
    return limits.unionByName(new)


def cascade_delete(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone, key, "left_anti")


def set_null(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    mark = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    return child.join(mark, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def monthly(findings: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Findings by key and month, by severity and module."""
    sev, mod = ("Critical", "High", "Medium", "Low", "Info"), {"SAST": "sast", "SecretDetection": "secrets", "DependencyAnalyzer": "dependencies", "ApiSecurity": "api"}
    return findings.groupBy(key, F.date_format(ts, "yyyy-MM").alias("year_month")).agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in sev], *[F.count_if(F.col("module_type") == m).alias(b) for m, b in mod.items()])


def upsert_monthly(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Statistics with the counts of ``new`` added on (key, year_month)."""
    numbers = [c for c in old.columns if c not in (key, "year_month")]
    return old.unionByName(new).groupBy(key, "year_month").agg(*[F.sum(c).alias(c) for c in numbers])


def win_mom(stats: DataFrame, key: str, value: str) -> DataFrame:
    """Change against the month before and the mean of six months."""
    w = Window.partitionBy(key).orderBy("year_month")
    return stats.select(key, "year_month", value, (F.col(value) - F.lag(value).over(w)).alias("change"), F.round(F.avg(value).over(w.rowsBetween(-5, 0)), 6).alias("trend"))


def win_cum_quota(use: DataFrame, key: str, order: str, amount: str, quota: Column) -> DataFrame:
    """Running use, its share of the quota and the highest alert level reached (0, 50, 75, 90 or 100)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pct = F.col("used") * 100.0 / quota
    level = F.when(pct >= 100, 100).when(pct >= 90, 90).when(pct >= 75, 75).when(pct >= 50, 50).otherwise(0)
    return use.withColumn("used", F.sum(amount).over(w)).withColumn("pct", F.round(F.least(pct, F.lit(100.0)), 6)).withColumn("level", level)


def agg_kpi(items: DataFrame) -> DataFrame:
    """Remediation rate, mean days to resolve, false-positive rate and open items of (status, found_at, resolved_at)."""
    done = F.col("status") == "Resolved"
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return items.agg(rate(done).alias("remediation_rate"), F.round(F.avg(F.when(done, F.datediff("resolved_at", "found_at"))), 6).alias("mttr_days"), rate(F.col("status") == "False Positive").alias("false_positive_rate"), F.count_if(F.col("status").isin("Open", "In Progress")).alias("open_items"))


def closure(edges: DataFrame, max_depth: int, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): all nodes reachable in at most ``max_depth`` steps, with the least depth; cycles are cut.

    With ``start`` (src) only paths from those nodes are followed.  Each round joins the frontier alone and keeps only
    what is new; frontiers are checkpointed in the shared folder, so that no round repeats those before it.
    """
    e = cut(edges.select("src", "dst").distinct())
    first = e if start is None else e.join(start.select("src").distinct(), "src", "left_semi")
    seen = frontier = first.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        hop = frontier.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = cut(hop.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def topo_levels(edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, level): length of the longest path into each node, for graphs no deeper than ``max_depth``.

    Each round's ends of paths are checkpointed in the shared folder.
    """
    e = cut(edges.select("src", "dst").distinct())
    level = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("level", F.lit(0))
    paths = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select(F.col("dst").alias("node"), F.lit(1).alias("level"))
    out = level.unionByName(paths)
    for depth in range(2, max_depth + 1):
        paths = cut(paths.join(e, paths["node"] == e["src"]).select(F.col("dst").alias("node"), F.lit(depth).alias("level")).distinct())
        out = out.unionByName(paths)
    return out.groupBy("node").agg(F.max("level").alias("level"))


DEPTHS = ("quick", "standard", "deep")


def taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, depth: str = "standard", max_steps: int = 10) -> DataFrame:
    """(src, dst, steps): sources whose data reaches a sink along ``edges`` (src, dst, within).

    ``sources``, ``sinks`` and ``sanitizers`` have one column, node.  A sanitizer ends every path that enters it or
    begins at it, unless it is null.  Levels: ``quick`` follows no data, only a source that is itself a sink is found
    (0 steps); ``standard`` adds edges within one function (``within`` true); ``deep`` adds those between functions.
    The fewest steps are given; longer paths than ``max_steps`` are not followed.
    """
    if depth not in DEPTHS:
        raise ValueError(f"{depth} is none of {DEPTHS}")
    clean = sanitizers.where("node IS NOT NULL").distinct()
    start = sources.distinct().join(clean, "node", "left_anti").select(F.col("node").alias("src"))
    ends = sinks.distinct().select(F.col("node").alias("dst"))
    at_once = start.select("src", F.col("src").alias("dst"), F.lit(0).alias("steps")).join(ends, "dst", "left_semi").select("src", "dst", "steps")
    if depth == "quick":
        return at_once
    live = edges if depth == "deep" else edges.where("within")
    live = live.join(clean.select(F.col("node").alias("src")), "src", "left_anti").join(clean.select(F.col("node").alias("dst")), "dst", "left_anti")
    reach = closure(live, max_steps, start).withColumnRenamed("depth", "steps").where("src <> dst")
    return at_once.unionByName(reach.join(ends, "dst", "left_semi").select("src", "dst", "steps"))
