"""Queries over findings."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregate as A
from ..operators import detect as D
from ..operators import orgs as O
from ..operators import sinks as S
from ..sources.shared import cut
from ..sources.stand_in import findings, table
from .base import query

_BUCKET = "CASE module_type WHEN 'SAST' THEN 'sast' WHEN 'SecretDetection' THEN 'secrets' WHEN 'DependencyAnalyzer' THEN 'dependencies' WHEN 'ApiSecurity' THEN 'api' ELSE 'sast' END"
_RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 WHEN 'Info' THEN 4 END"
_FIRST = f", b AS (SELECT *, {_BUCKET} AS bucket FROM findings WHERE ok), first AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY job_id, bucket, id ORDER BY ord) = 1)"
_SEV = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("Critical", "High", "Medium", "Low", "Info"))
_PKG = "CASE WHEN instr(dep_path, ':') > 0 AND instr(dep_path[instr(dep_path, ':') + 1:], '@') > 0 THEN split_part(dep_path[instr(dep_path, ':') + 1:], '@', 1) ELSE dep_path END"
_CLUSTERS = ", clusters AS (SELECT path, line, rule_id, list_sort(list(DISTINCT module_type)) AS modules, count(DISTINCT module_type) AS n, list(id ORDER BY job_id, ord) AS ids FROM findings GROUP BY ALL)"
_INDEX = _CLUSTERS + ", idx AS (SELECT id, n FROM (SELECT DISTINCT unnest(ids) AS id, path, line, rule_id, n FROM clusters) QUALIFY row_number() OVER (PARTITION BY id ORDER BY path DESC, line DESC NULLS LAST, rule_id DESC NULLS LAST) = 1)"


@query("agg_bucket", f", b AS (SELECT *, {_BUCKET} AS bucket FROM findings WHERE ok) SELECT job_id, bucket, count(*) AS n FROM b GROUP BY ALL", "findings")
def agg_bucket(spark, d):
    return A.agg_bucket(findings(spark, d))


@query("module_counts", " SELECT job_id, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed FROM findings GROUP BY job_id", "findings")
def module_counts(spark, d):
    return A.module_counts(findings(spark, d))


@query("dedup_first", _FIRST + " SELECT job_id, bucket, id, severity, path, line, rule_id FROM first", "findings")
def dedup_first(spark, d):
    return A.dedup_first(findings(spark, d)).select("job_id", "bucket", "id", "severity", "path", "line", "rule_id")


@query("union_buckets", _FIRST + " SELECT bucket, severity, count(*) AS n FROM first GROUP BY ALL", "findings")
def union_buckets(spark, d):
    f = A.dedup_first(findings(spark, d))
    return f.groupBy("bucket", "severity").agg(F.count("*").alias("n"))


@query("agg_summary", _FIRST + f" SELECT job_id, count(*) AS total, count(*) FILTER (bucket = 'sast') AS by_sast, count(*) FILTER (bucket = 'secrets') AS by_secrets, count(DISTINCT CASE WHEN bucket = 'dependencies' THEN {_PKG} END) AS by_dependencies, count(*) FILTER (bucket = 'api') AS by_api, {_SEV} FROM first GROUP BY job_id", "findings")
def agg_summary(spark, d):
    return A.agg_summary(findings(spark, d))


_STR = "CASE WHEN json_valid(recommendation) THEN CASE WHEN json_type(recommendation, '$.{0}') = 'VARCHAR' THEN json_extract_string(recommendation, '$.{0}') END END"


@query("agg_dep_group", _FIRST + f""", x AS (SELECT *, {_PKG} AS package, split_part(dep_path, ':', 1) AS ecosystem, split_part(dep_path, '@', 2) AS version, {_RANK} AS rk, json_valid(recommendation) AS js, {_STR.format("nearest_safe")} AS near, {_STR.format("latest_safe")} AS late FROM first WHERE bucket = 'dependencies')
SELECT job_id, package, arg_min(ecosystem, ord) AS ecosystem, arg_min(version, ord) AS current_version, (['Critical', 'High', 'Medium', 'Low', 'Info'])[min(rk) + 1] AS severity, string_agg(coalesce(rule_id, id) || ':' || severity, ',' ORDER BY ord) AS cves,
coalesce(arg_max(near, ord) FILTER (js AND near IS NOT NULL), arg_min(recommendation, ord) FILTER (NOT js AND recommendation IS NOT NULL)) AS nearest_safe, arg_max(late, ord) FILTER (late IS NOT NULL) AS latest_safe, count(*) || ' vulnerabilities found' AS summary FROM x GROUP BY job_id, package""", "findings")
def agg_dep_group(spark, d):
    return A.agg_dep_group(findings(spark, d))


@query("agg_correlate", _CLUSTERS + " SELECT path, line, rule_id, array_to_string(modules, ',') AS modules, CAST(n AS INTEGER) AS n_modules, array_to_string(ids, ',') AS ids FROM clusters", "findings")
def agg_correlate(spark, d):
    return A.agg_correlate(findings(spark, d)).withColumn("modules", F.array_join("modules", ",")).withColumn("ids", F.array_join("ids", ","))


@query("agg_corr_index", _INDEX + " SELECT id, CAST(n AS INTEGER) AS n_modules FROM idx", "findings")
def agg_corr_index(spark, d):
    return A.agg_corr_index(A.agg_correlate(findings(spark, d)))


_SCORE = "CASE severity WHEN 'Critical' THEN 100 WHEN 'High' THEN 80 WHEN 'Medium' THEN 50 WHEN 'Low' THEN 20 WHEN 'Info' THEN 5 ELSE 0 END + CASE confidence WHEN 'High' THEN 15 WHEN 'Medium' THEN 8 WHEN 'Low' THEN 3 ELSE 0 END"


@query("rank_findings", _INDEX + f" SELECT id, severity, confidence, CAST({_SCORE} + least((coalesce(n, 1) - 1) * 10, 30) AS INTEGER) AS score FROM findings LEFT JOIN idx USING (id) ORDER BY score DESC, id", "findings")
def rank_findings(spark, d):
    f = findings(spark, d)
    return A.rank_findings(f, A.agg_corr_index(A.agg_correlate(f))).select("id", "severity", "confidence", "score")


@query("join_corr_score", _INDEX + " SELECT f.job_id, f.ord, f.id, CAST(coalesce(n, 1) AS INTEGER) AS n_modules FROM findings f LEFT JOIN idx USING (id)", "findings")
def join_corr_score(spark, d):
    f = findings(spark, d)
    return f.join(A.agg_corr_index(A.agg_correlate(f)), "id", "left").select("job_id", F.col("ord").cast("long").alias("ord"), "id", F.coalesce("n_modules", F.lit(1)).alias("n_modules"))


@query("sort_clusters", _CLUSTERS + " SELECT path, line, rule_id, CAST(n AS INTEGER) AS n_modules FROM clusters ORDER BY path NULLS FIRST, line NULLS FIRST, rule_id NULLS FIRST", "findings")
def sort_clusters(spark, d):
    return A.sort_clusters(A.agg_correlate(findings(spark, d))).select("path", "line", "rule_id", "n_modules")


@query("agg_job_counters", f" SELECT job_id, count(*) AS total, {_SEV} FROM findings GROUP BY job_id", "findings")
def agg_job_counters(spark, d):
    return A.agg_job_counters(findings(spark, d))


_MONTH = "strftime(ts, '%Y-%m') AS year_month, count(*) AS findings, " + _SEV + ", count(*) FILTER (module_type = 'SAST') AS sast, count(*) FILTER (module_type = 'SecretDetection') AS secrets, count(*) FILTER (module_type = 'DependencyAnalyzer') AS dependencies, count(*) FILTER (module_type = 'ApiSecurity') AS api"
_OWNED = ", owned AS (SELECT f.*, o_custkey AS user_id, c_nationkey AS org_id FROM findings f JOIN orders ON o_orderkey = CAST(job_id AS BIGINT) JOIN customer ON c_custkey = o_custkey)"


def _owned(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    jobs = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"))
    return findings(spark, d).join(jobs, "job_id")


@query("agg_monthly_org", _OWNED + f" SELECT org_id, {_MONTH} FROM owned GROUP BY org_id, year_month", "findings")
def agg_monthly_org(spark, d):
    return O.monthly(_owned(spark, d), "org_id")


@query("agg_monthly_user", _OWNED + f" SELECT user_id, {_MONTH} FROM owned GROUP BY user_id, year_month", "findings")
def agg_monthly_user(spark, d):
    return O.monthly(_owned(spark, d), "user_id")


@query("win_mom", _OWNED + ", m AS (SELECT org_id, strftime(ts, '%Y-%m') AS year_month, count(*) AS findings FROM owned GROUP BY ALL) SELECT *, findings - lag(findings) OVER w AS change, round(avg(findings) OVER (PARTITION BY org_id ORDER BY year_month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS trend FROM m WINDOW w AS (PARTITION BY org_id ORDER BY year_month)", "findings")
def win_mom(spark, d):
    return O.win_mom(O.monthly(_owned(spark, d), "org_id"), "org_id", "findings")


@query("win_share", " SELECT module_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM findings GROUP BY module_type", "findings")
def win_share(spark, d):
    return A.share(findings(spark, d), "module_type")


@query("agg_by_dim", " SELECT path, count(*) AS n, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Critical') > 0 AS alert FROM findings GROUP BY path", "findings")
def agg_by_dim(spark, d):
    g = findings(spark, d).groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Critical").alias("critical"))
    return g.withColumn("alert", F.col("critical") > 0)


@query("topk_enrich", f" SELECT job_id, id, severity, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_RANK}, ord) AS place FROM findings) WHERE place <= 10", "findings")
def topk_enrich(spark, d):
    return A.topk_per_job(findings(spark, d)).select("job_id", "id", "severity", "place")


@query("topk_projects", " SELECT path, count(*) AS n FROM findings GROUP BY path ORDER BY n DESC, path LIMIT 10", "findings")
def topk_projects(spark, d):
    return findings(spark, d).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10)


@query("min_severity", " SELECT job_id, id, severity FROM findings WHERE severity IN ('Critical', 'High')", "findings")
def min_severity(spark, d):
    return D.min_severity(findings(spark, d), "High").select("job_id", "id", "severity")


@query("min_confidence", " SELECT job_id, id, confidence FROM findings WHERE confidence IN ('High', 'Medium')", "findings")
def min_confidence(spark, d):
    return D.min_confidence(findings(spark, d), "Medium").select("job_id", "id", "confidence")


@query("require_reco", " SELECT job_id, id, recommendation FROM findings WHERE recommendation IS NOT NULL", "findings")
def require_reco(spark, d):
    return findings(spark, d).where("recommendation IS NOT NULL").select("job_id", "id", "recommendation")


@query("glob_exclude", " SELECT path, count(*) AS n FROM findings WHERE NOT regexp_matches(path, '^src/f1[^/]*\\.py$|^.*/f2[^/]\\.py$') GROUP BY path", "findings")
def glob_exclude(spark, d):
    return D.glob_exclude(findings(spark, d), ("src/f1*.py", "**/f2?.py")).groupBy("path").agg(F.count("*").alias("n"))


@query("filter_ui", " SELECT job_id, id FROM findings WHERE severity IN ('Critical', 'High') AND module_type = 'SAST' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01'", "findings")
def filter_ui(spark, d):
    return findings(spark, d).where("severity IN ('Critical', 'High') AND module_type = 'SAST' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01'").select("job_id", "id")


@query("policy_filter", _OWNED.replace("c_nationkey AS org_id", "c_mktsegment AS project") + " SELECT job_id, id, severity, project FROM owned WHERE severity IN ('Critical', 'High') AND regexp_matches(project, '^[^/]*ING$|^[^/]*ING$')", "findings")
def policy_filter(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    jobs = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("c_mktsegment").alias("project"))
    return D.policy_filter(findings(spark, d).join(jobs, "job_id"), ("Critical", "High"), "*ING").select("job_id", "id", "severity", "project")


@query("resource_filter", " SELECT job_id, id, module_type FROM findings WHERE module_type IN ('SAST', 'ApiSecurity')", "findings")
def resource_filter(spark, d):
    return findings(spark, d).where(F.col("module_type").isin("SAST", "ApiSecurity")).select("job_id", "id", "module_type")


@query("notify_rule", " SELECT date_trunc('week', ts) AS week, count(*) AS critical FROM findings WHERE severity = 'Critical' GROUP BY week", "findings")
def notify_rule(spark, d):
    return findings(spark, d).where("severity = 'Critical'").groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("critical"))


_FP = "sha256(path || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || coalesce(rule_id, ''))"


@query("baseline_diff", f", fp AS (SELECT *, {_FP} AS fingerprint FROM findings) SELECT job_id, id, fingerprint FROM fp WHERE fingerprint NOT IN (SELECT fingerprint FROM fp WHERE ts < TIMESTAMP '1996-01-01')", "findings")
def baseline_diff(spark, d):
    f = findings(spark, d).withColumn("fingerprint", D.fingerprint(F.col("path"), F.col("line"), F.col("rule_id")))
    return D.baseline_diff(f, f.where("ts < TIMESTAMP '1996-01-01'").select("fingerprint")).select("job_id", "id", "fingerprint")


@query("exempt", ", e AS (SELECT DISTINCT o_orderkey || '-1' AS id, CAST(o_orderdate AS DATE) AS expires FROM orders) SELECT job_id, f.id FROM findings f WHERE f.id NOT IN (SELECT id FROM e WHERE DATE '1997-01-01' <= expires)", "findings")
def exempt(spark, d):
    e = table(spark, d, "orders").select(F.concat("o_orderkey", F.lit("-1")).alias("id"), F.to_date("o_orderdate").alias("expires"))
    return D.exempt(findings(spark, d), e, F.lit("1997-01-01").cast("date")).select("job_id", "id")


@query("fix_join", " SELECT f.job_id, f.id, e_text AS explanation FROM findings f LEFT JOIN (SELECT o_orderkey || '-2' AS id, o_orderpriority AS e_text FROM orders WHERE o_orderstatus = 'F') USING (id)", "findings")
def fix_join(spark, d):
    e = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat("o_orderkey", F.lit("-2")).alias("id"), F.col("o_orderpriority").alias("explanation"))
    return findings(spark, d).join(e, "id", "left").select("job_id", "id", "explanation")


@query("flatten_results", ", r AS (SELECT job_id, module_type, list(id ORDER BY ord) AS ids FROM findings GROUP BY ALL) SELECT job_id, module_type, unnest(ids) AS id FROM r", "findings")
def flatten_results(spark, d):
    r = findings(spark, d).groupBy("job_id", "module_type").agg(F.collect_list("id").alias("ids"))
    return r.select("job_id", "module_type", F.explode("ids").alias("id"))


@query("sink_sarif")
def sink_sarif(spark, d):
    none = F.lit(None).cast("long")
    f = findings(spark, d).withColumns({"column": none, "end_line": none, "end_column": none, "description": F.concat(F.lit("found in "), F.col("path"))})
    return S.sink_sarif(f)


@query("sarif_level", " SELECT severity, CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM findings GROUP BY ALL", "findings")
def sarif_level(spark, d):
    return findings(spark, d).groupBy("severity", scalar.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


@query("sink_report", ", r AS (SELECT job_id, module_type, bool_and(ok) AS ok, count(*) AS n FROM findings GROUP BY ALL) SELECT job_id, module_type, CASE WHEN ok THEN 'Completed' ELSE 'Failed' END AS status, CASE WHEN ok THEN n ELSE 0 END AS n_findings FROM r", "findings")
def sink_report(spark, d):
    r = findings(spark, d).groupBy("job_id", "module_type").agg(F.every("ok").alias("good"), F.count("*").alias("n"))
    return S.sink_report(r.select("job_id", "module_type", F.when(~F.col("good"), "failed").alias("error"), F.when(F.col("good"), F.col("n")).alias("n_findings")))


@query("sink_metrics", " SELECT 'findings_' || lower(severity) || ' ' || count(*) AS line FROM findings GROUP BY severity", "findings")
def sink_metrics(spark, d):
    return S.sink_metrics(findings(spark, d).groupBy(F.concat(F.lit("findings_"), F.lower("severity")).alias("name")).agg(F.count("*").alias("value")))


@query("sev_score", f" SELECT severity, confidence, CAST({_SCORE} AS INTEGER) AS score, count(*) AS n FROM findings GROUP BY ALL", "findings")
def sev_score(spark, d):
    s = scalar.sev_score(F.col("severity")) + scalar.conf_score(F.col("confidence"))
    return findings(spark, d).groupBy("severity", "confidence", s.cast("int").alias("score")).agg(F.count("*").alias("n"))


@query("sev_compare", f", p AS (SELECT job_id, id, severity, lag(severity) OVER (PARTITION BY job_id ORDER BY ord) AS before FROM findings) SELECT job_id, id, severity, before, {_RANK} < coalesce({_RANK.replace('severity', 'before')}, 4) AS higher FROM p", "findings")
def sev_compare(spark, d):
    from pyspark.sql import Window

    f = findings(spark, d).withColumn("before", F.lag("severity").over(Window.partitionBy("job_id").orderBy("ord")))
    return f.select("job_id", "id", "severity", "before", scalar.sev_higher(F.col("severity"), F.col("before")).alias("higher"))


@query("dep_parse", f", p AS (SELECT DISTINCT CASE WHEN line = 7 THEN path WHEN line = 6 THEN 'npm:@babel/core@7.0.0' ELSE dep_path END AS dep_path FROM findings) SELECT dep_path, CASE WHEN dep_path NOT LIKE '%:%@%' THEN 'unknown' ELSE split_part(dep_path, ':', 1) END AS ecosystem, {_PKG} AS package, CASE WHEN dep_path NOT LIKE '%:%@%' THEN 'unknown' ELSE dep_path[instr(dep_path, ':') + 1:][instr(dep_path[instr(dep_path, ':') + 1:], '@') + 1:] END AS version FROM p", "findings")
def dep_parse(spark, d):
    p = findings(spark, d).select(F.when(F.col("line") == 7, F.col("path")).when(F.col("line") == 6, "npm:@babel/core@7.0.0").otherwise(F.col("dep_path")).alias("dep_path")).distinct()
    return p.select("dep_path", scalar.dep_parse(F.col("dep_path")).alias("p")).select("dep_path", "p.*")


@query("json_reco", f" SELECT recommendation, coalesce(json_valid(recommendation), false) AS is_json, CASE WHEN json_valid(recommendation) THEN {_STR.format('nearest_safe')} ELSE recommendation END AS nearest_safe, {_STR.format('latest_safe')} AS latest_safe, count(*) AS n FROM findings GROUP BY ALL", "findings")
def json_reco(spark, d):
    g = findings(spark, d).groupBy("recommendation").agg(F.count("*").alias("n"))
    return g.withColumn("r", scalar.json_reco(F.col("recommendation"))).select("recommendation", "r.*", "n")


@query("fmt_summary", " SELECT job_id, count(*) || ' vulnerabilities found' AS summary FROM findings GROUP BY job_id", "findings")
def fmt_summary(spark, d):
    return findings(spark, d).groupBy("job_id").agg(F.count("*").alias("n")).select("job_id", scalar.fmt_summary(F.col("n")).alias("summary"))


@query("agg_kpi", ", i AS (SELECT CASE line % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved' WHEN 3 THEN 'False Positive' ELSE 'Acknowledged' END AS status, CAST(ts AS DATE) AS found_at, CAST(ts AS DATE) + CAST(line * 3 AS INTEGER) AS resolved_at FROM findings) SELECT round(count(*) FILTER (status = 'Resolved') / count(*), 6) AS remediation_rate, round(avg(resolved_at - found_at) FILTER (status = 'Resolved'), 6) AS mttr_days, round(count(*) FILTER (status = 'False Positive') / count(*), 6) AS false_positive_rate, count(*) FILTER (status IN ('Open', 'In Progress')) AS open_items FROM i", "findings")
def agg_kpi(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("Open", "In Progress", "Resolved", "False Positive", "Acknowledged"))), (F.col("line") % 5 + 1).cast("int"))
    day = F.to_date("ts")
    return O.agg_kpi(findings(spark, d).select(s.alias("status"), day.alias("found_at"), F.date_add(day, (F.col("line") * 3).cast("int")).alias("resolved_at")))


def _deps(spark, d):
    """The distinct dependencies of the findings, kept as a table: else filters on parsed versions, which take regular
    expressions, are pushed below the distinct and run on every finding, in each scan that uses the dependencies."""
    paths = cut(findings(spark, d).select("dep_path").distinct())
    return paths.select(scalar.dep_parse(F.col("dep_path")).alias("p")).select("p.*").distinct()


@query("join_advisory", ", dep AS (SELECT DISTINCT split_part(dep_path, ':', 1) AS ecosystem, split_part(split_part(dep_path, ':', 2), '@', 1) AS package, split_part(dep_path, '@', 2) AS version FROM findings), adv AS (SELECT 'ADV-' || p_partkey AS advisory, 'npm' AS ecosystem, 'pkg' || (p_partkey % 50) AS package, CAST(p_partkey % 4 AS INTEGER) AS lo, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_partkey % 4 + 2 AS INTEGER) END AS hi FROM part) SELECT dep.*, advisory FROM dep JOIN adv USING (ecosystem, package) WHERE CAST(split_part(version, '.', 1) AS INTEGER) >= lo AND (hi IS NULL OR CAST(split_part(version, '.', 1) AS INTEGER) < hi)", "findings")
def join_advisory(spark, d):
    deps = _deps(spark, d)
    k = F.col("p_partkey") % 4
    adv = table(spark, d, "part").select(F.concat(F.lit("ADV-"), "p_partkey").alias("advisory"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg"), F.col("p_partkey") % 50).alias("package"), F.concat(k, F.lit(".0.0")).alias("introduced"), F.when(F.col("p_size") % 3 != 0, F.concat(k + 2, F.lit(".0"))).alias("fixed"))
    return D.join_advisory(deps, adv).select("ecosystem", "package", "version", "advisory")


@query("union_advisories", "SELECT advisory, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CAST(min(rk) AS INTEGER) AS rank FROM (SELECT 'A' || p_partkey % 500 AS advisory, 'osv' AS source, p_partkey % 5 AS rk FROM part UNION ALL SELECT 'A' || p_partkey % 300, 'nvd', p_partkey % 3 + 1 FROM part UNION ALL SELECT 'A' || p_partkey % 700, 'ghsa', 4 FROM part) GROUP BY advisory")
def union_advisories(spark, d):
    p = table(spark, d, "part")
    name = lambda k: F.element_at(F.array(*map(F.lit, ("Critical", "High", "Medium", "Low", "Info"))), (k + 1).cast("int"))
    one = lambda m, s, k: p.select(F.concat(F.lit("A"), F.col("p_partkey") % m).alias("advisory"), F.lit(s).alias("source"), name(k).alias("severity"))
    return D.union_advisories(one(500, "osv", F.col("p_partkey") % 5), one(300, "nvd", F.col("p_partkey") % 3 + 1), one(700, "ghsa", F.lit(4)))


_SAFE = """, v AS (SELECT DISTINCT split_part(dep_path, ':', 1) AS ecosystem, split_part(split_part(dep_path, ':', 2), '@', 1) AS package, split_part(dep_path, '@', 2) AS version FROM findings),
k AS (SELECT *, CAST(split_part(version, '.', 1) AS INTEGER) AS major, CAST(split_part(version, '.', 2) AS INTEGER) AS minor FROM v),
c AS (SELECT ecosystem, package, version AS candidate, major AS cmajor, minor AS cminor, cmajor * 1000 + cminor AS ck FROM k WHERE (cmajor + cminor) % 3 <> 0),
j AS (SELECT k.ecosystem, k.package, k.version, k.major, k.minor, candidate, cmajor, cminor, ck, ck >= k.major * 1000 + k.minor AS up FROM k LEFT JOIN c USING (ecosystem, package)),
g AS (SELECT ecosystem, package, version, major, minor, arg_min(candidate, ck) FILTER (up) AS nearest_safe, arg_max(candidate, ck) AS latest_safe, arg_min(candidate, ck) FILTER (up AND cmajor = major AND cminor > minor) AS next_minor FROM j GROUP BY ALL)
SELECT ecosystem, package, version, nearest_safe, latest_safe, next_minor, CASE WHEN nearest_safe IS NULL THEN 'unknown' WHEN CAST(split_part(nearest_safe, '.', 1) AS INTEGER) <> major THEN 'major' WHEN CAST(split_part(nearest_safe, '.', 2) AS INTEGER) <> minor THEN 'minor' ELSE 'none' END AS impact FROM g"""


@query("det_safe_version", _SAFE, "findings")
def det_safe_version(spark, d):
    deps = _deps(spark, d)
    part = lambda k: F.split("candidate", "\\.")[k].cast("int")
    versions = deps.select("ecosystem", "package", F.col("version").alias("candidate")).distinct().withColumn("safe", (part(0) + part(1)) % 3 != 0)
    return D.safe_version(deps, versions)


@query("semver_overlap", "WITH a AS (SELECT 'p' || p_partkey % 100 AS package, p_partkey % 7 AS lo, p_partkey % 7 + 2 AS hi FROM part), b AS (SELECT 'p' || s_suppkey AS package, s_suppkey % 5 AS lo, s_suppkey % 5 + 3 AS hi FROM supplier) SELECT package, greatest(a.lo, b.lo) || '.0' AS lo, least(a.hi, b.hi) || '.0' AS hi FROM a JOIN b USING (package) WHERE greatest(a.lo, b.lo) < least(a.hi, b.hi)")
def semver_overlap(spark, d):
    v = lambda k: F.concat(k, F.lit(".0"))
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    a = table(spark, d, "part").select(F.concat(F.lit("p"), k % 100).alias("package"), v(k % 7).alias("lo"), v(k % 7 + 2).alias("hi"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("p"), s).alias("package"), v(s % 5).alias("lo"), v(s % 5 + 3).alias("hi"))
    return D.semver_overlap(a, b, "package")
