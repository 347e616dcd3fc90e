"""Bucketing, deduplication, summaries, dependency grouping, correlation and ranking of findings.

Inputs are flat findings (job_id, module_type, module_ord, ord, id, severity, ...); ``ord`` is their order in the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..schema import SEVERITIES


def severity_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{s.lower()}") for s in SEVERITIES]


def bucketed(findings: DataFrame) -> DataFrame:
    """Findings of successful results with their bucket."""
    return findings.where("ok").withColumn("bucket", scalar.module_bucket(F.col("module_type")))


def agg_bucket(findings: DataFrame) -> DataFrame:
    return bucketed(findings).groupBy("job_id", "bucket").agg(F.count("*").alias("n"))


def module_counts(results: DataFrame) -> DataFrame:
    """Completed and failed modules of each job."""
    return results.groupBy("job_id").agg(F.count_if(F.col("ok")).alias("completed"), F.count_if(~F.col("ok")).alias("failed"))


def dedup_first(findings: DataFrame) -> DataFrame:
    """The first finding of each id within a bucket of a job; the same id survives in two buckets."""
    first = Window.partitionBy("job_id", "bucket", "id").orderBy("ord")
    return bucketed(findings).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def agg_summary(findings: DataFrame) -> DataFrame:
    """Totals of deduplicated findings by job; by_dependencies counts packages, so the parts need not add up."""
    first = dedup_first(findings).withColumn("package", F.when(F.col("bucket") == "dependencies", scalar.dep_parse(F.col("dep_path"))["package"]))
    of = lambda b: F.count_if(F.col("bucket") == b)
    return first.groupBy("job_id").agg(F.count("*").alias("total"), of("sast").alias("by_sast"), of("secrets").alias("by_secrets"), F.countDistinct("package").alias("by_dependencies"), of("api").alias("by_api"), *severity_counts())


def agg_dep_group(findings: DataFrame) -> DataFrame:
    """Dependency findings by package alone: ecosystem and version of the first, highest severity, ordered list of
    vulnerabilities, and the two recommendations (last JSON string, for nearest_safe otherwise the first plain text)."""
    d, r = scalar.dep_parse(F.col("dep_path")), scalar.json_reco(F.col("recommendation"))
    x = dedup_first(findings).where("bucket = 'dependencies'").withColumn("d", d).withColumn("r", r).withColumn("rank", scalar.sev_rank(F.col("severity")))
    js, plain = F.col("r.is_json"), ~F.col("r.is_json") & F.col("recommendation").isNotNull()
    pick = lambda name: F.max_by(F.when(js, F.col(name)), F.when(js & F.col(name).isNotNull(), F.col("ord")))
    g = x.groupBy("job_id", F.col("d.package").alias("package")).agg(
        F.min_by("d.ecosystem", "ord").alias("ecosystem"),
        F.min_by("d.version", "ord").alias("current_version"),
        F.min("rank").alias("rank"),
        F.sort_array(F.collect_list(F.struct("ord", F.coalesce("rule_id", "id").alias("cve"), "severity"))).alias("found"),
        F.coalesce(pick("r.nearest_safe"), F.min_by(F.when(plain, F.col("recommendation")), F.when(plain, F.col("ord")))).alias("nearest_safe"),
        pick("r.latest_safe").alias("latest_safe"),
    )
    cves = F.array_join(F.transform("found", lambda f: F.concat(f["cve"], F.lit(":"), f["severity"])), ",")
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank") + 1)
    return g.select("job_id", "package", "ecosystem", "current_version", severity.alias("severity"), cves.alias("cves"), "nearest_safe", "latest_safe", scalar.fmt_summary(F.size("found")).alias("summary"))


def agg_correlate(findings: DataFrame) -> DataFrame:
    """Clusters of all findings at one (path, line, rule); null equals null; modules sorted, ids in input order."""
    g = findings.groupBy("path", "line", "rule_id").agg(F.array_sort(F.collect_set("module_type")).alias("modules"), F.sort_array(F.collect_list(F.struct("job_id", "ord", "id"))).alias("found"))
    return g.select("path", "line", "rule_id", "modules", F.size("modules").alias("n_modules"), F.transform("found", lambda f: f["id"]).alias("ids"))


def agg_corr_index(clusters: DataFrame) -> DataFrame:
    """Finding id -> number of modules; an id in several clusters takes the last in key order, nulls first."""
    key = F.struct("path", F.col("line").isNotNull(), "line", F.col("rule_id").isNotNull(), "rule_id")
    return clusters.select(F.explode(F.array_distinct("ids")).alias("id"), key.alias("k"), "n_modules").groupBy("id").agg(F.max_by("n_modules", "k").alias("n_modules"))


def rank_findings(findings: DataFrame, index: DataFrame) -> DataFrame:
    """Findings with their score, best first and then by id; ids without a cluster count as one module."""
    n = F.coalesce("n_modules", F.lit(1))
    score = scalar.sev_score(F.col("severity")) + scalar.conf_score(F.col("confidence")) + F.least((n - 1) * 10, F.lit(30))
    return findings.join(index, "id", "left").withColumn("score", score.cast("int")).orderBy(F.desc("score"), "id")


def sort_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.asc_nulls_first("path"), F.asc_nulls_first("line"), F.asc_nulls_first("rule_id"))


def agg_job_counters(findings: DataFrame) -> DataFrame:
    return findings.groupBy("job_id").agg(F.count("*").alias("total"), *severity_counts())


def share(df: DataFrame, key: str) -> DataFrame:
    """Rows and share of all rows by ``key``; the window runs over the few aggregated rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def quality_gate(found: DataFrame, expected: DataFrame, by: str, least_precision: float = 0.70, least_recall: float = 0.50) -> DataFrame:
    """Precision and recall of (key, by) sets by group, from one full outer join."""
    f, e = found.withColumn("f", F.lit(1)), expected.withColumn("e", F.lit(1))
    g = f.join(e, ["key", by], "full").groupBy(by).agg(F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 6))
    p, r = ratio(F.col("tp"), F.col("fp")), ratio(F.col("tp"), F.col("fn"))
    return g.select(by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), (F.coalesce(p, F.lit(0.0)) >= least_precision).__and__(F.coalesce(r, F.lit(0.0)) >= least_recall).alias("passed"))


def topk_per_job(findings: DataFrame, k: int = 10) -> DataFrame:
    """At most ``k`` findings of each job, the most severe first, then in order."""
    best = Window.partitionBy("job_id").orderBy(F.asc_nulls_last(scalar.sev_rank(F.col("severity"))), "ord")
    return findings.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
