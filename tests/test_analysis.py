"""Analyzers, data flow, workflow operations, module runner and limits, case by case."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sievelight.functions import scalar
from sievelight.operators import api, detect, jobs, modules, orgs, workflow
from sievelight.sources import shared
from sievelight.streaming import jobs as streaming


def rules(spark, spec, **options):
    df = spark.createDataFrame([(1, spec if isinstance(spec, str) or spec is None else json.dumps(spec))], "key long, spec string")
    return {(r.path, r.method, r.rule_id, r.severity) for r in api.det_api(df, "key", "spec", **options).collect()}


GOOD = {
    "openapi": "3.1.0",
    "info": {"version": "2"},
    "servers": [{"url": "http://localhost:80"}],
    "components": {"securitySchemes": {"o": {"type": "oauth2", "flows": {"authorizationCode": {"tokenUrl": "https://x/t"}}}}},
    "security": [{"o": ["read"]}],
    "paths": {"/a": {"summary": "s", "post": {"parameters": [{"name": "id", "in": "path", "schema": {"type": "string", "maxLength": 5}}], "requestBody": {"content": {"application/json": {"schema": {"type": "object"}}}}, "responses": {"200": {"headers": {h: {} for h in ("CONTENT-Security-Policy", "strict-transport-security", "X-Frame-Options", "X-Content-Type-Options")}}, "429": {}, "default": {}}}}},
}


def test_a_good_specification_has_no_findings(spark):
    assert rules(spark, GOOD) == set()


@pytest.mark.parametrize("text", [None, "", "[]", "no json", "{}", '{"swagger":"2.0","paths":{"/a":{"get":{}}}}'])
def test_what_is_no_specification_has_no_findings(spark, text):
    assert rules(spark, text) == set()


def test_each_fault_is_found(spark):
    bad = json.loads(json.dumps(GOOD))
    bad["servers"] = [{"url": "http://api.x"}]
    bad["components"]["securitySchemes"] |= {"b": {"type": "http", "scheme": "Basic"}, "i": {"type": "oauth2", "flows": {"implicit": {"authorizationUrl": "http://x"}}}}
    del bad["info"]["version"]
    op = bad["paths"]["/a"]["post"]
    op["security"] = [{"o": []}]
    op["parameters"] = [{"name": "api_key", "in": "query", "schema": {"type": "string"}}]
    op["requestBody"] = {"content": {"text/plain": {}}}
    op["responses"] = {"201": {"headers": {"access-control-allow-origin": {"example": "*"}}}}
    bad["paths"]["/b"] = {"get": {"security": [], "responses": {"404": {}}}, "parameters": {}}
    got = rules(spark, bad)
    assert {r for p, _, r, _ in got if p is None} == {"weak_scheme", "implicit_flow", "insecure_token_url", "missing_version", "insecure_server"}
    assert {r for p, _, r, _ in got if p == "/a"} == {"missing_scopes", "unbounded_parameter", "missing_request_schema", "sensitive_parameter", "missing_security_headers", "insecure_cors", "missing_error_responses", "missing_rate_limit"}
    assert {r for p, _, r, _ in got if p == "/b"} == {"missing_authentication", "missing_rate_limit"}
    assert {a for _, _, r, a in rules(spark, bad, overrides={"insecure_cors": "Info"}) if r == "insecure_cors"} == {"Info"}
    assert {p for p, *_ in rules(spark, bad, exclude=("/a",))} == {None, "/b"}
    assert {r for _, _, r, _ in rules(spark, bad, enabled=("authentication",))} == {"weak_scheme", "missing_authentication"}


def audit(spark, rows):
    full = [(j, s, dt.datetime(2024, 1, 1, 0, 0, s), o, d) for j, s, o, d in rows]
    return workflow.workflow(spark.createDataFrame(full, "job_id long, seq int, ts timestamp, op string, detail string"))


def test_workflow_from_start_to_end(spark):
    got = audit(spark, [(1, 1, "enqueue", None), (1, 2, "start", None), (1, 3, "complete", "7"), (1, 4, "cancel", "late"), (1, 5, "fail", "boom"), (1, 6, "unknown", None)])
    rows = got.orderBy("seq").collect()
    assert [(r.from_status, r.to_status, r.applied) for r in rows] == [("Pending", "Queued", True), ("Queued", "Running", True), ("Running", "Completed", True), ("Completed", "Completed", False), ("Completed", "Completed", False), ("Completed", "Completed", False)]
    assert [r.reason for r in rows[:4]] == ["Enqueued for background processing", "Worker started execution", "Completed with 7 findings", None]
    assert [r.error for r in rows] == [None] * 4 + ["boom", "boom"]
    (job,) = workflow.jobs(got).collect()
    assert (job.status, job.error, job.snapshots) == ("Completed", "boom", 3)
    assert (job.started_at.second, job.completed_at.second) == (2, 3)


def test_workflow_rejects_what_is_no_edge(spark):
    got = audit(spark, [(1, 1, "start", None), (1, 2, "complete", "1"), (2, 1, "fail", "early"), (3, 1, "cancel", "no need"), (3, 2, "enqueue", None), (4, 1, "enqueue", None), (4, 2, "enqueue", None), (4, 3, "start", None), (4, 4, "fail", "disk"), (None, 1, "enqueue", None)])
    last = {r.job_id: (r.status, r.error, r.snapshots) for r in workflow.jobs(got).collect()}
    assert last == {1: ("Pending", None, 0), 2: ("Pending", "early", 0), 3: ("Cancelled", None, 1), 4: ("Failed", "disk", 3), None: ("Queued", None, 1)}
    assert {r.reason for r in got.where("applied AND job_id IN (3, 4)").collect()} == {"Cancelled: no need", "Enqueued for background processing", "Worker started execution", "Execution failed: disk"}
    assert workflow.workflow(got.limit(0).select("job_id", "seq", "ts", "op", F.col("reason").alias("detail"))).count() == 0


def test_taint_levels_and_sanitizers(spark):
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    e = spark.createDataFrame([(1, 2, True), (2, 3, False), (3, 1, True), (1, 4, True), (4, 5, True), (None, 3, True)], "src long, dst long, within boolean")
    run = lambda depth, clean=(), steps=10: {tuple(r) for r in orgs.taint(e, nodes(1, 9), nodes(2, 3, 5, 9), nodes(*clean), depth, steps).collect()}
    assert run("quick") == {(9, 9, 0)}
    assert run("standard") == {(9, 9, 0), (1, 2, 1), (1, 5, 2)}
    assert run("deep") == {(9, 9, 0), (1, 2, 1), (1, 3, 2), (1, 5, 2)}
    assert run("deep", (4, 9)) == {(1, 2, 1), (1, 3, 2)} and run("deep", (1,)) == {(9, 9, 0)}
    assert run("deep", steps=1) == {(9, 9, 0), (1, 2, 1)}
    with pytest.raises(ValueError):
        run("deeper")


def test_inherited_limits_end_at_ten_steps_and_at_cycles(spark):
    o = [(f"n{k}", f"n{k + 1}") for k in range(13)] + [("n13", None), ("a", "b"), ("b", "a"), ("gap", "none"), ("none", None), ("own", "n13")]
    lim = [(f"n{k}", f"t{k}", True) for k in range(14)] + [("a", "ta", True), ("b", "tb", True), ("gap", "tg", True), ("own", "to", False)]
    limits = spark.createDataFrame([(i, t, 1, 1, h) for i, t, h in lim], "organization_id string, tier string, max_scans_monthly int, max_api_calls_monthly int, inherit_limits boolean")
    got = {r.id: r.organization_id for r in orgs.hier_limits(spark.createDataFrame(o, "id string, parent_id string"), limits).collect()}
    assert got["n0"] == "n10" and got["n5"] == "n13" and got["a"] == "a" and got["b"] == "b"
    assert got["gap"] is None and got["none"] is None and got["own"] == "own"


SECRETS = {
    "aws-secret-key": "aws_secret_access_key = " + "a1B2" * 10,
    "aws-session-token": "AWS_SESSION_TOKEN=" + "x" * 120,
    "azure-storage-key": "AccountKey=" + "k" * 86 + "==",
    "azure-client-secret": "abc8Q~" + "d" * 34,
    "gcp-service-account": '{"type": "service_account"}',
    "oauth-bearer": "Authorization: Bearer " + "t" * 20,
    "twilio-key": "SK" + "0a" * 16,
    "sendgrid-key": "SG." + "a" * 22 + "." + "b" * 43,
    "github-fine-token": "github_pat_" + "a" * 70,
    "pypi-token": "pypi-AgE" + "c" * 60,
    "digitalocean-token": "dop_v1_" + "ab" * 32,
    "pgp-private-key": "-----BEGIN PGP PRIVATE KEY BLOCK-----",
    "jdbc-password": "jdbc:mysql://h/db?user=a&password=secret1",
    "slack-webhook": "https://hooks.slack.com/services/T" + "A" * 8 + "/B" + "C" * 8 + "/" + "d" * 24,
}


def test_secret_families(spark):
    assert len({r for r, _, _ in detect.SECRET_RULES}) == len(detect.SECRET_RULES) >= 40
    assert set(detect.HINTS) == {r for r, _, _ in detect.SECRET_RULES}
    df = spark.createDataFrame([*SECRETS.items(), ("none", "nothing to see"), ("null", None), ("empty", "")], "key string, text string")
    got = {}
    for r in detect.det_regex(df, "key", "text").collect():
        got.setdefault(r.key, set()).add(r.rule_id)
    assert all(rule in got[rule] for rule in SECRETS) and not set(got) & {"none", "null", "empty"}


def test_hints_lose_no_match(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = detect.det_regex(docs, "doc_id", "text").groupBy("rule_id").count().collect()
    hints, detect.HINTS = detect.HINTS, {}
    try:
        assert {tuple(r) for r in detect.det_regex(docs, "doc_id", "text").groupBy("rule_id").count().collect()} == {tuple(r) for r in seen}
    finally:
        detect.HINTS = hints


def test_modules(spark):
    texts = spark.createDataFrame([("f1", "eval(x) AKIA" + "A" * 16)], "key string, text string")
    found = modules.run_modules({"texts": texts}, configs={"SecretDetection": {"min_severity": "Critical", "unknown": 1}})
    assert found.columns == list(modules.FINDING)
    assert {(r.module_type, r.rule_id) for r in found.collect()} == {("SAST", "eval-call"), ("SecretDetection", "aws-access-key")}
    assert modules.REGISTRY["SecretDetection"].prepare({"unknown": 1}) == {"min_severity": "Low"}
    with pytest.raises(ValueError):
        modules.run_modules({"specs": texts}, ("SAST",))


def test_prereleases_come_before_their_release(spark):
    order = ["1.0.0-alpha", "1.0.0-rc1", "1.0.0-rc2", "1.0.0", "1.0.1-rc1", "1.0.1"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    key = {r.v: list(r.k) for r in df.select("v", scalar.version_key(F.col("v")).alias("k")).collect()}
    assert sorted(order, key=key.get) == order and key["1.0.0"] == key["1.0.0"] != key["1.0.0-rc1"]
    deps = spark.createDataFrame([("npm", "p", "1.0.0-rc1"), ("npm", "p", "1.0.0")], "ecosystem string, package string, version string")
    adv = spark.createDataFrame([("A", "npm", "p", "0.1", "1.0.0")], "advisory string, ecosystem string, package string, introduced string, fixed string")
    assert [r.version for r in detect.join_advisory(deps, adv).collect()] == ["1.0.0-rc1"]


def test_limits_of_callers(spark):
    df = spark.createDataFrame([("api_key", True), ("anonymous", False), ("x", None)], "caller string, is_member boolean")
    assert [(r.per_minute, r.per_hour, r.burst) for r in streaming.tier_limits(df).collect()] == [(120, 2400, 24), (10, 100, 5), (10, 100, 5)]


def test_lockout_lasts_fifteen_minutes(spark):
    t = dt.datetime(2024, 1, 1)
    seconds = [0, 10, 20, 30, 40, 50, 51, 940, 960, 5000]
    df = spark.createDataFrame([("u", t + dt.timedelta(seconds=s)) for s in seconds], "user string, ts timestamp")
    got = {int((r.ts - t).total_seconds()): (r.over, r.locked) for r in streaming.lockout(df, "user").collect()}
    assert [s for s in seconds if got[s][0]] == [50, 51] and [s for s in seconds if got[s][1]] == [51, 940]


def test_listing_skips_folders_and_what_overflows(spark):
    rows = [("b", "in/", 1), ("b", "in/a", 60), ("b", "in/b", 50), ("b", "in/c", 40), ("b", "out/a", 1), ("b", "in/d", None)]
    df = spark.createDataFrame(rows, "bucket string, key string, size long")
    assert {r.key for r in jobs.win_cap(jobs.list_objects(df, "in/"), "bucket", 9, 100).collect()} == {"in/a", "in/c"}


def test_many_events_of_one_user_are_one_pass(spark):
    df = spark.range(200_000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit("view").alias("event_type"))
    assert streaming.token_bucket(df, 5, 0.5).where("allowed").count() in range(100_000, 100_010)


def test_the_shared_folder_is_that_of_the_session(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_state_that_sees_nothing_is_dropped():
    import pandas as pd

    class State:
        exists, hasTimedOut, get, timeout = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            self.timeout = ms

        def remove(self):
            self.exists, self.get = False, None

    step, state = streaming.lifecycle_step(7_200_000), State()
    batch = lambda *rows: iter([pd.DataFrame([(1, s, t, pd.Timestamp("2024-01-01")) for s, t in rows], columns=["job_id", "seq", "to_status", "ts"])])
    (out,) = step((1,), batch((2, "Running"), (1, "Queued")), state)
    assert out["applied"].tolist() == [True, True] and state.get == ("Running", 2) and state.timeout == 7_200_000
    (out,) = step((1,), batch((2, "Running"), (3, "Queued"), (4, "Failed")), state)
    assert out["applied"].tolist() == [False, False, True] and out["from_status"].tolist() == ["Running"] * 3
    state.hasTimedOut = True
    assert list(step((1,), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    (out,) = step((1,), batch((5, "Queued")), state)
    assert out["from_status"].tolist() == ["Pending"]


def test_filters_on_versions_do_not_run_on_every_finding(spark, small):
    """The findings are read once, for their distinct dependencies; what is parsed and joined after that is a small table."""
    from sievelight.plans.registry import QUERIES

    for name in ("det_safe_version", "join_advisory"):
        df = QUERIES[name](spark, small)
        assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0
