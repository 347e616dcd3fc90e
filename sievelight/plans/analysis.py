"""Queries of the analyzers, data flow, workflow operations and caller limits."""

from pyspark.sql import functions as F

from ..operators import api as API
from ..operators import detect as D
from ..operators import jobs as J
from ..operators import modules as M
from ..operators import orgs as O
from ..operators import workflow as W
from ..sources.stand_in import table
from ..streaming import jobs as ST
from .base import query
from .platform import _CAP, _EDGES, _edges

# --- specifications ------------------------------------------------------------------------------------------------


def _bit(k):
    return F.getbit(F.col("p_partkey"), F.lit(k)) == 1


def _specs(spark, d):
    """A specification for each part; the bits of its key say which faults it has."""
    on = lambda k, yes, no="": F.when(_bit(k), yes).otherwise(no)
    headers = '"Content-Security-Policy":{},"Strict-Transport-Security":{},"X-Frame-Options":{},"X-Content-Type-Options":{}'
    cors = '"Access-Control-Allow-Origin":{"schema":{"example":"*"}}'
    both = F.concat_ws(",", F.when(_bit(4), headers), F.when(_bit(5), cors))
    text = F.concat(
        F.lit('{"openapi":"3.0.1","info":{"title":"t"'), on(9, ',"version":"1"'), F.lit('},"servers":[{"url":"'), on(8, "http", "https"), F.lit('://api.test"}],"components":{"securitySchemes":{"main":{"type":"oauth2","flows":{"'),
        on(6, "implicit", "authorizationCode"), F.lit('":{"authorizationUrl":"'), on(3, "http", "https"), F.lit('://id.test"}}}}},"paths":{"'), F.when(F.col("p_partkey") % 11 == 0, "/health/live").otherwise("/items"), F.lit('":{"get":{'),
        on(0, F.concat(F.lit('"security":[{"main":['), on(1, '"read"'), F.lit("]}],"))), F.lit('"parameters":[{"name":"'), on(2, "password", "id"), F.lit('","in":"query","schema":{"type":"string"'), on(7, ',"maxLength":9'), F.lit('}}],"responses":{"200":{"headers":{'), both, F.lit("}}"),
        on(10, ',"404":{},"429":{}'), F.lit("}}}}}"),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), text.alias("spec"))


def _faults():
    whole = (("implicit_flow", "(k >> 6) & 1 = 1"), ("insecure_token_url", "(k >> 3) & 1 = 1"), ("missing_version", "(k >> 9) & 1 = 0"), ("insecure_server", "(k >> 8) & 1 = 1"))
    each = (("missing_authentication", "k & 1 = 0"), ("missing_scopes", "k & 3 = 1"), ("unbounded_parameter", "(k >> 7) & 1 = 0"), ("sensitive_parameter", "(k >> 2) & 1 = 1"), ("missing_security_headers", "(k >> 4) & 1 = 0"), ("insecure_cors", "(k >> 5) & 1 = 1"), ("missing_error_responses", "(k >> 10) & 1 = 0"), ("missing_rate_limit", "(k >> 10) & 1 = 0"))
    row = "SELECT k AS key, {0} AS path, {1} AS method, '{2}' AS analyzer, '{3}' AS rule_id, '{4}' AS severity FROM p WHERE {5}"
    out = [row.format("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", *_rule(r), c) for r, c in whole]
    return out + [row.format("'/items'", "'get'", *_rule(r), f"k % 11 <> 0 AND {c}") for r, c in each]


def _rule(rule):
    analyzer, severity = API.RULES[rule]
    return analyzer, rule, "Critical" if rule == "insecure_cors" else severity


def _api(spark, d):
    return API.det_api(_specs(spark, d), "key", "spec", overrides={"insecure_cors": "Critical"}, exclude=("/health",))


@query("det_api", "WITH p AS (SELECT p_partkey AS k FROM part) " + " UNION ALL ".join(_faults()))
def det_api(spark, d):
    return _api(spark, d)


# --- secrets -------------------------------------------------------------------------------------------------------

_STATE = "CASE WHEN rule_id IN ({}) THEN 'Unverified' ELSE 'NotSupported' END".format(", ".join(f"'{r}'" for r in D.VERIFIABLE))
_HITS = "(" + " UNION ALL ".join("SELECT doc_id, '{0}' AS rule_id, unnest(regexp_extract_all(text, '{1}')) AS m FROM documents".format(r, p.replace("'", "''")) for r, p, _ in D.SECRET_RULES) + ")"


@query("det_verify", f"SELECT rule_id, {_STATE} AS verification_state, count(*) AS n FROM {_HITS} GROUP BY ALL")
def det_verify(spark, d):
    return D.det_verify(D.det_regex(table(spark, d, "documents"), "doc_id", "text")).groupBy("rule_id", "verification_state").agg(F.count("*").alias("n"))


@query("det_context", "SELECT path, m AS match FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'src/a' WHEN 1 THEN 'tests/b' ELSE 'src/c_test.py' END AS path, unnest(regexp_extract_all(text, '[0-9A-Za-z+/=_-]{20,}')) AS m FROM documents) WHERE path = 'src/a' AND NOT regexp_matches(m, '(?i)(example|placeholder|changeme|dummy|your[_-])')")
def det_context(spark, d):
    path = F.when(F.col("doc_id") % 3 == 0, "src/a").when(F.col("doc_id") % 3 == 1, "tests/b").otherwise("src/c_test.py")
    hits = table(spark, d, "documents").select(path.alias("path"), F.explode(F.regexp_extract_all("text", F.lit("[0-9A-Za-z+/=_-]{20,}"), F.lit(0))).alias("match"))
    return D.det_context(hits, "match", "path")


# --- modules -------------------------------------------------------------------------------------------------------

_FOUND = "SELECT 'ApiSecurity' AS module_type, rule_id, count(*) AS n FROM (WITH p AS (SELECT p_partkey AS k FROM part) " + " UNION ALL ".join(_faults()).replace("'Critical'", "'High'") + ") GROUP BY rule_id"
_SECRETS = " UNION ALL ".join("SELECT 'SecretDetection', '{0}', sum(len(regexp_extract_all(text, '{1}'))) FROM documents HAVING sum(len(regexp_extract_all(text, '{1}'))) > 0".format(r, p.replace("'", "''")) for r, p, s in D.SECRET_RULES if s != "Info")


@query("run_modules", f"SELECT module_type, rule_id, CAST(n AS BIGINT) AS n FROM ({_FOUND} UNION ALL {_SECRETS})")
def run_modules(spark, d):
    inputs = {"texts": table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), "specs": _specs(spark, d)}
    found = M.run_modules(inputs, ("SecretDetection", "ApiSecurity", "DependencyAnalyzer"), {"ApiSecurity": {"exclude_paths": ("/health",)}})
    return found.groupBy("module_type", "rule_id").agg(F.count("*").alias("n"))


# --- data flow -----------------------------------------------------------------------------------------------------

_FLOW = _EDGES + ", x AS (SELECT src, dst, src // 250 = dst // 250 AS within FROM e WHERE src % 7 <> 0 AND dst % 7 <> 0), r AS (SELECT src, dst, 1 AS steps FROM x WHERE src < 200 {0} UNION SELECT r.src, x.dst, r.steps + 1 FROM r JOIN x ON x.src = r.dst WHERE r.steps < 4 {0}), f AS (SELECT DISTINCT p_partkey AS src, p_partkey AS dst, 0 AS steps FROM part WHERE p_partkey BETWEEN 150 AND 199 AND p_partkey % 7 <> 0 UNION ALL SELECT src, dst, min(steps) FROM r WHERE dst >= 150 AND src <> dst GROUP BY src, dst) SELECT src, dst, CAST(min(steps) AS INTEGER) AS steps FROM f GROUP BY src, dst"


def _taint(spark, d, depth):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    e = _edges(spark, d).withColumn("within", F.floor(F.col("src") / 250) == F.floor(F.col("dst") / 250))
    sinks = p.where("node >= 150").union(e.where("dst >= 150").select("dst")).distinct()
    return O.taint(e, p.where("node < 200"), sinks, p.union(e.select("dst")).where("node % 7 = 0"), depth, 4)


@query("det_taint", _FLOW.format(""))
def det_taint(spark, d):
    return _taint(spark, d, "deep")


@query("det_taint_standard", _FLOW.format("AND x.within"))
def det_taint_standard(spark, d):
    return _taint(spark, d, "standard")


@query("det_taint_quick", "SELECT p_partkey AS src, p_partkey AS dst, CAST(0 AS INTEGER) AS steps FROM part WHERE p_partkey BETWEEN 150 AND 199 AND p_partkey % 7 <> 0")
def det_taint_quick(spark, d):
    return _taint(spark, d, "quick")


# --- workflow ------------------------------------------------------------------------------------------------------

_AUDIT = """WITH RECURSIVE r AS (SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderdate AS ts, (['enqueue', 'start', 'complete', 'fail', 'cancel'])[o_orderkey % 5 + 1] AS op, CAST(o_orderkey % 100 AS VARCHAR) AS detail FROM orders),
t AS (SELECT *, (['Queued', 'Running', 'Completed', 'Failed', 'Cancelled'])[list_position(['enqueue', 'start', 'complete', 'fail', 'cancel'], op)] AS target FROM r),
f AS (SELECT job_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, '' AS op, '' AS from_status, 'Pending' AS to_status, false AS applied, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT job_id FROM r)
UNION ALL SELECT t.job_id, t.seq, t.ts, t.op, f.to_status, CASE WHEN EDGE THEN t.target ELSE f.to_status END, EDGE, CASE WHEN EDGE THEN CASE t.op WHEN 'enqueue' THEN 'Enqueued for background processing' WHEN 'start' THEN 'Worker started execution' WHEN 'complete' THEN 'Completed with ' || t.detail || ' findings' WHEN 'fail' THEN 'Execution failed: ' || t.detail ELSE 'Cancelled: ' || t.detail END END, CASE WHEN t.op = 'fail' THEN t.detail ELSE f.error END FROM f JOIN t ON t.job_id = f.job_id AND t.seq = f.seq + 1),
a AS (SELECT * FROM f WHERE seq > 0) """.replace("EDGE", "((f.to_status, t.target) IN (('Pending', 'Queued'), ('Pending', 'Cancelled'), ('Queued', 'Running'), ('Queued', 'Cancelled'), ('Running', 'Completed'), ('Running', 'Failed')))")


def _audit(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    op = F.element_at(F.array(*map(F.lit, W.TARGETS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return W.workflow(table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.row_number().over(w).cast("long").alias("seq"), F.col("o_orderdate").alias("ts"), op.alias("op"), (F.col("o_orderkey") % 100).cast("string").alias("detail")))


@query("wf_audit", _AUDIT + "SELECT * FROM a")
def wf_audit(spark, d):
    return _audit(spark, d)


@query("wf_jobs", _AUDIT + "SELECT job_id, arg_max(to_status, seq) AS status, max(error) FILTER (seq = last) AS error, min(ts) FILTER (applied AND op = 'start') AS started_at, min(ts) FILTER (applied AND op IN ('complete', 'fail', 'cancel')) AS completed_at, count(*) FILTER (applied) AS snapshots FROM (SELECT *, max(seq) OVER (PARTITION BY job_id) AS last FROM a) GROUP BY job_id")
def wf_jobs(spark, d):
    return W.jobs(_audit(spark, d))


def _operation(op):
    @query(f"wf_{op}", _AUDIT + f"SELECT job_id, seq, from_status, to_status, reason, error FROM a WHERE op = '{op}' AND applied")
    def run(spark, d):
        return _audit(spark, d).where(f"op = '{op}' AND applied").select("job_id", "seq", "from_status", "to_status", "reason", "error")

    return run


for _name in W.TARGETS:
    _operation(_name)

# --- listings and limits -------------------------------------------------------------------------------------------

_KEYS = "SELECT p_brand, p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'in/' WHEN 1 THEN 'out/' ELSE 'in/x/' END || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || CASE WHEN p_partkey % 5 = 0 THEN '/' ELSE '' END AS key FROM part"


@query("scan_s3", _CAP.replace("SELECT p_brand AS bucket, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS key, CAST(p_size AS BIGINT) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part", f"SELECT p_brand AS bucket, key, CAST(p_size AS BIGINT) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY key) AS k FROM ({_KEYS}) WHERE key LIKE 'in/%' AND key NOT LIKE '%/'"))
def scan_s3(spark, d):
    k = F.col("p_partkey") % 3
    key = F.concat(F.when(k == 0, "in/").when(k == 1, "out/").otherwise("in/x/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.when(F.col("p_partkey") % 5 == 0, "/").otherwise(""))
    objects = table(spark, d, "part").select(F.col("p_brand").alias("bucket"), key.alias("key"), F.col("p_size").alias("size"))
    return J.win_cap(J.list_objects(objects, "in/"), "bucket", 20, 400)


@query("tier_limits", "SELECT c_custkey, caller, is_member, CAST(CASE WHEN is_member THEN floor(m * 1.2) ELSE m END AS INTEGER) AS per_minute, CAST(CASE WHEN is_member THEN floor(h * 1.2) ELSE h END AS INTEGER) AS per_hour, CAST(CASE WHEN is_member THEN floor(b * 1.2) ELSE b END AS INTEGER) AS burst FROM (SELECT *, CASE caller WHEN 'api_key' THEN 100 WHEN 'authenticated' THEN 60 ELSE 10 END AS m, CASE caller WHEN 'api_key' THEN 2000 WHEN 'authenticated' THEN 1000 ELSE 100 END AS h, CASE caller WHEN 'api_key' THEN 20 WHEN 'authenticated' THEN 10 ELSE 5 END AS b FROM (SELECT c_custkey, (['api_key', 'authenticated', 'anonymous', 'other'])[c_custkey % 4 + 1] AS caller, c_custkey % 3 = 0 AS is_member FROM customer))")
def tier_limits(spark, d):
    caller = F.element_at(F.array(*map(F.lit, ("api_key", "authenticated", "anonymous", "other"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return ST.tier_limits(table(spark, d, "customer").select("c_custkey", caller.alias("caller"), (F.col("c_custkey") % 3 == 0).alias("is_member")))


@query("auth_lockout", "WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM (SELECT event_id, user_id % 10 AS user_id, ts FROM events)), o AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) > 2 OR count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) > 5 AS over FROM e) SELECT event_id, user_id, over, coalesce(bool_or(over) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 900 PRECEDING AND 1 PRECEDING), false) AS locked FROM o")
def auth_lockout(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("user_id"), "ts")
    return ST.lockout(e, "user_id", 2, 5).drop("ts")
