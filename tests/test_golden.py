"""Literal cases of the operators."""

import datetime as dt
import random
import re
import tempfile

from pyspark.sql import functions as F

from sievelight import schema
from sievelight.functions import scalar
from sievelight.operators import aggregate as A
from sievelight.operators import detect as D
from sievelight.operators import jobs as J
from sievelight.operators import orgs as O
from sievelight.operators import planning as P
from sievelight.operators import sinks as S
from sievelight.sources import files
from sievelight.streaming import jobs as ST

FLAT = "job_id string, module_type string, ord int, id string, severity string, confidence string, path string, line long, rule_id string, ok boolean, dep_path string, recommendation string"


def findings(spark, *rows):
    base = {"job_id": "j", "module_type": "SAST", "severity": "High", "confidence": "High", "path": "src/app.py", "line": 12, "rule_id": "rule-a", "ok": True, "dep_path": None, "recommendation": None}
    names = [f.split()[0] for f in FLAT.split(", ")]
    full = [base | {"ord": k, "id": f"f{k}"} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FLAT)


def test_correlate_two_modules(spark):
    f = findings(spark, {"id": "sast-1"}, {"id": "sec-1", "module_type": "SecretDetection", "ok": False})
    (r,) = A.agg_correlate(f).collect()
    assert r.modules == ["SAST", "SecretDetection"] and r.ids == ["sast-1", "sec-1"]


def test_rank_scores(spark):
    rows = [{"id": "f-critical", "severity": "Critical", "confidence": "Medium", "path": "other"}]
    rows += [{"id": "f-high", "module_type": m} for m in ("SAST", "SecretDetection", "ApiSecurity", "DependencyAnalyzer")]
    f = findings(spark, *rows)
    got = A.rank_findings(f.dropDuplicates(["id"]), A.agg_corr_index(A.agg_correlate(f))).select("id", "score").collect()
    assert [(r.id, r.score) for r in got] == [("f-high", 125), ("f-critical", 108)]


def test_null_keys_form_one_cluster(spark):
    f = findings(spark, {"line": None, "rule_id": None}, {"line": None, "rule_id": None}, {"line": 1})
    assert A.agg_correlate(f).count() == 2
    assert A.sort_clusters(A.agg_correlate(f)).first().line is None


def test_dedup_first_within_bucket(spark):
    f = findings(spark, {"id": "a", "severity": "Low"}, {"id": "a"}, {"id": "a", "module_type": "ApiSecurity"}, {"id": "b", "ok": False}, {"id": "a", "module_type": "CSPM"})
    got = {(r.bucket, r.id, r.severity) for r in A.dedup_first(f).collect()}
    assert got == {("sast", "a", "Low"), ("api", "a", "High")}


def test_summary_counts_packages(spark):
    d = {"module_type": "DependencyAnalyzer"}
    f = findings(spark, d | {"dep_path": "npm:x@1"}, d | {"dep_path": "pypi:x@2", "severity": "Odd"}, d | {"dep_path": "plain"}, {})
    r = A.agg_summary(f).first()
    assert (r.total, r.by_dependencies, r.by_sast, r.high) == (4, 2, 1, 3)


def test_dep_group_folds(spark):
    d = {"module_type": "DependencyAnalyzer"}
    f = findings(
        spark,
        d | {"dep_path": "npm:x@1", "severity": "Low", "recommendation": "plain text"},
        d | {"dep_path": "pypi:x@2", "severity": "Critical", "recommendation": '{"nearest_safe":"1.1","latest_safe":"2"}'},
        d | {"dep_path": "npm:x@3", "rule_id": None, "recommendation": '{"nearest_safe":"1.2"}'},
        d | {"dep_path": "npm:x@3", "recommendation": "7"},
    )
    (r,) = A.agg_dep_group(f).collect()
    assert (r.ecosystem, r.current_version, r.severity, r.nearest_safe, r.latest_safe) == ("npm", "1", "Critical", "1.2", "2")
    assert r.cves == "rule-a:Low,rule-a:Critical,f2:High,rule-a:High" and r.summary == "4 vulnerabilities found"


def test_dep_parse(spark):
    cases = {"npm:lodash@4.17.15": ("npm", "lodash", "4.17.15"), "npm:@babel/core@7.0.0": ("npm", "", "babel/core@7.0.0"), "maven:g:a@1": ("maven", "g:a", "1"), "a:b": ("unknown", "a:b", "unknown"), "plain": ("unknown", "plain", "unknown")}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: tuple(r.d) for r in df.select("p", scalar.dep_parse(F.col("p")).alias("d")).collect()} == cases


def test_json_reco(spark):
    cases = {'{"nearest_safe":"1","latest_safe":"2"}': ("1", "2"), '{"nearest_safe":5}': (None, None), "{}": (None, None), "1.2": (None, None), '"x"': (None, None), "1.2.3": ("1.2.3", None), "do it": ("do it", None), "{'a':1}": ("{'a':1}", None)}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: tuple(r.d)[1:] for r in df.select("p", scalar.json_reco(F.col("p")).alias("d")).collect()} == cases


def test_s3_uris(spark):
    cases = {
        "s3://my-bucket": ("my-bucket", None, None),
        "s3://my-bucket/path/to/project": ("my-bucket", "path/to/project", None),
        "https://my-bucket.s3.amazonaws.com": ("my-bucket", None, None),
        "https://my-bucket.s3.us-west-2.amazonaws.com/prefix": ("my-bucket", "prefix", "us-west-2"),
        "https://s3.us-east-1.amazonaws.com/my-bucket/prefix": ("my-bucket", "prefix", "us-east-1"),
        "s3://": (None, None, None),
        "ftp://bucket": (None, None, None),
        "not-a-valid-url": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: tuple(r.s) for r in df.select("u", scalar.parse_s3_uri(F.col("u")).alias("s")).collect()} == cases


def test_limits(spark):
    df = spark.createDataFrame([(1 << 20, "SecretDetection"), (100 << 20, "SAST"), (10 << 20, "SAST"), (10 << 20, "DependencyAnalyzer"), (10 << 30, "SAST"), (None, "SAST")], "b long, m string")
    small, large, ten, deps, huge, none = [r.l for r in df.select(scalar.calc_limits(F.col("b"), F.col("m")).alias("l")).collect()]
    assert small.timeout_ms == 60_200 and large.timeout_ms == 100_000 and large.max_memory > small.max_memory
    assert deps.timeout_ms >= ten.timeout_ms and huge.max_memory == 8 << 30 and huge.timeout_ms == 600_000
    assert none.timeout_ms == 60_000
    fixed = df.select(scalar.calc_limits(F.col("b"), F.col("m"), dynamic=False).alias("l")).first().l
    assert tuple(fixed) == (60_000, 1 << 30)


def test_transition_matrix(spark):
    every = [(a, b) for a in schema.STATUSES for b in schema.STATUSES]
    got = {(r.from_status, r.to_status) for r in J.sm_validate(spark.createDataFrame(every, "from_status string, to_status string")).where("valid").collect()}
    assert got == set(schema.JOB_EDGES) and ("Running", "Cancelled") not in got


def test_state_machine_matches_a_sequential_model(spark):
    rng, rows, want = random.Random(5), [], {}
    for job in range(40):
        status, start, end, applied = "Pending", None, None, 0
        for seq in range(rng.randint(1, 8)):
            to, ts = rng.choice(schema.STATUSES), dt.datetime(2024, 1, 1, 0, seq)
            rows.append((job, seq, to, ts))
            if (status, to) in schema.JOB_EDGES:
                status, applied = to, applied + 1
                start = ts if to == "Running" else start
                end = ts if to in schema.TERMINAL else end
        want[job] = (status, start, end, applied)
    df = spark.createDataFrame(rows, "job_id int, seq int, to_status string, ts timestamp")
    assert {r.job_id: tuple(r)[1:] for r in J.sm_apply(df).collect()} == want


def _lpt(sizes, n):
    load, to = [0] * min(n, len(sizes)), {}
    for path, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0].split("/"))):
        k = load.index(min(load))
        load[k] += size
        to[path] = k
    return to


def test_shards(spark):
    cases = [({"a": 120, "b": 100, "c": 80, "d": 60}, 2), ({"x": 1000, "y": 900, "s": 100, "t": 100}, 2), ({"one": 5}, 8), ({"a/b": 7, "a-b": 7}, 2)]
    for sizes, n in cases:
        df = spark.createDataFrame([("g", p, s) for p, s in sizes.items()], "g string, path string, size long")
        assert {r.path: r.shard for r in J.shard_lpt(df, "g", n).collect()} == _lpt(sizes, n)
    assert J.shard_lpt(df, "g", 0).count() == 0


def test_limits_of_a_deep_tree(spark):
    orgs = [("o0", None)] + [(f"o{k}", f"o{k - 1}") for k in range(1, 14)] + [("p", "missing"), ("q", "gap"), ("gap", None), ("x", "y"), ("y", "x")]
    lim = [(f"o{k}", f"t{k}", k > 0) for k in range(14)] + [("p", "tp", True), ("q", "tq", True), ("x", "tx", True), ("y", "ty", True)]
    o = spark.createDataFrame(orgs, "id string, parent_id string").withColumn("name", F.col("id"))
    s = spark.createDataFrame(lim, "organization_id string, tier string, inherit_limits boolean").withColumns({"max_scans_monthly": F.lit(1), "max_api_calls_monthly": F.lit(2)})
    got = {r.id: r.tier for r in O.hier_limits(o, s).collect()}
    assert got["o0"] == "t0" and got["o9"] == "t0" and got["o10"] == "t0" and got["o12"] == "t2"
    assert got["p"] is None and got["q"] is None and got["x"] == "tx"
    assert {r.id: r.effective_tier for r in O.view_effective(o, s).collect()}["q"] == "free"


def test_scan_and_detect_a_tree(spark):
    root = tempfile.mkdtemp()
    import os

    for p in ("Cargo.toml", "src/main.rs", "manage.py", "package.json", "Dockerfile", "target/x.rs", ".env", "a/b/c/d/e/f.py"):
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write("x")
    found = files.scan_dir(spark, root)
    assert {r.path for r in found.collect()} == {"Cargo.toml", "src/main.rs", "manage.py", "package.json", "Dockerfile"}
    r = P.agg_project(P.lang_detect(found.withColumn("project_id", F.lit(1)))).first()
    assert r.languages == ["javascript", "python", "rust"] and r.frameworks == ["django", "docker"]
    assert files.scan_size(spark, f"{root}/missing").first().bytes is None
    assert files.scan_size(spark, f"{root}/Cargo.toml").first().bytes == 1


def test_redaction_and_hmac(spark):
    df = spark.createDataFrame([("postgres://u:p@h/db",), ("redis://h",)], "u string")
    assert [r[0] for r in df.select(scalar.redact_url(F.col("u"))).collect()] == ["postgres://***@h/db", "redis://h"]
    for secret in ("k", "x" * 100):
        r = S.sign(spark.createDataFrame([("12", '{"a":"é"}')], "ts string, body string"), secret).first()
        assert r.signature == S.reference_hmac(secret, r.ts, r.body)
    waits = []
    assert S.deliver(iter([("b", "s")]), lambda b, s: False, waits.append) == [False] and waits == [1.0, 2.0]


def test_sarif_leaves_out_absent_members(spark):
    import json

    f = findings(spark, {"line": None, "rule_id": None}, {}).withColumns({"column": F.lit(3).cast("long"), "end_line": F.lit(None).cast("long"), "end_column": F.lit(None).cast("long"), "description": F.lit("d")})
    run = json.loads(S.sink_sarif(f).first().sarif)["runs"][0]
    a, b = run["results"]
    assert "ruleId" not in a and "region" not in a["locations"][0]["physicalLocation"] and a["level"] == "error"
    assert b["locations"][0]["physicalLocation"]["region"] == {"startLine": 12, "startColumn": 3} and run["properties"]["total_findings"] == 2


def test_versions(spark):
    df = spark.createDataFrame([("1.2.3", "2.0"), ("1.2", "1.3.0"), ("1.0.0.5", "1.0.1"), ("x", "1")], "a string, b string")
    assert [r[0] for r in df.select(scalar.version_impact(F.col("a"), F.col("b"))).collect()] == ["major", "minor", "patch", "unknown"]
    deps = spark.createDataFrame([("npm", "p", "1.1.0")], "ecosystem string, package string, version string")
    v = spark.createDataFrame([("npm", "p", c, s) for c, s in (("1.0.0", True), ("1.1.5", True), ("1.2.0", True), ("1.3.0-rc1", True), ("2.0.0", True), ("3.0.0", False))], "ecosystem string, package string, candidate string, safe boolean")
    assert tuple(D.safe_version(deps, v).first())[3:] == ("1.1.5", "2.0.0", "1.2.0", "patch")


def test_token_bucket_matches_a_model(spark):
    rng, rows, want = random.Random(2), [], {}
    tokens, at, t = 5.0, None, 0
    for k in range(60):
        t += rng.randint(0, 3)
        kind = rng.choice(list(ST.COSTS))
        rows.append((k, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), kind))
        tokens = min(5.0, tokens + (t - (t if at is None else at)) * 1.0)
        at = t
        want[k] = tokens >= ST.COSTS[kind]
        tokens -= ST.COSTS[kind] if want[k] else 0
    df = spark.createDataFrame(rows, "event_id long, user_id int, ts timestamp, event_type string")
    assert {r.event_id: r.allowed for r in ST.token_bucket(df, 5, 1.0).collect()} == want


def test_lifecycle_stream(spark):
    folder = tempfile.mkdtemp()
    kind = "job_id long, seq int, to_status string, ts timestamp"
    rows = [(1, 1, "Queued"), (1, 2, "Running"), (1, 3, "Cancelled"), (1, 4, "Completed"), (2, 1, "Running")]
    spark.createDataFrame([(*r, dt.datetime(2024, 1, 1)) for r in rows], kind).coalesce(1).write.parquet(f"{folder}/in")
    got = []
    q = ST.lifecycle(ST.queue(spark, f"{folder}/in", kind)).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.job_id, r.seq): r.applied for r in got} == {(1, 1): True, (1, 2): True, (1, 3): False, (1, 4): True, (2, 1): False}


def test_join_registry_and_exemptions(spark):
    w = spark.createDataFrame([(1, "SAST"), (1, "SBOM")], "job_id int, module_type string")
    r = P.join_registry(spark.createDataFrame([(1, "SAST", None)], "job_id int, module_type string, error string"), w)
    assert {x.module_type: x.error for x in r.collect()} == {"SAST": None, "SBOM": "no result: SBOM"}
    f = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("b", dt.date(2023, 1, 1))], "id string, expires date")
    assert [x.id for x in D.exempt(f, e, F.lit("2023-06-01").cast("date")).collect()] == ["b"]


def test_a_package_json_is_parsed_once_whatever_it_holds(spark):
    import json

    rng, names = random.Random(3), [*(p for ps in P.FRAMEWORKS.values() for p in ps), "left-pad", "React", "", "a\"b", "x.y", "é"]
    odd = [None, "", " ", "null", "1", "[]", "{", '"react"', '{"a":1,"a":2}', '{"dependencies":{"react":1,"react":2}}', ' {"dependencies" : {"react":null}} ', '{"Dependencies":{"react":"1"}}', '{"x":{"dependencies":{"react":"1"}}}', '{"dependencies":"react","devDependencies":{"vue":"1"}}', '{"dependencies":["react"],"devDependencies":{"nuxt":[1]}}']
    value = lambda: rng.choice(["1", None, 5, ["react"], {"next": "1"}, True])
    section = lambda: rng.choice([None, "react", 7, ["vue"], {}, *[{n: value() for n in rng.sample(names, rng.randint(1, 5))} for _ in range(8)]])
    texts = odd + [json.dumps({s: section() for s in rng.sample([*P.SECTIONS, "scripts", "name"], rng.randint(0, 5))}, ensure_ascii=rng.random() < 0.5) for _ in range(300)]

    def model(text):
        def once(pairs):
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError("a key twice")
            return dict(pairs)

        try:
            found = json.loads(text, object_pairs_hook=once)
        except (TypeError, ValueError):
            return []
        inside = [found[s] for s in P.SECTIONS if isinstance(found.get(s), dict)] if isinstance(found, dict) else []
        return [f for f, packages in P.FRAMEWORKS.items() if any(p in d for d in inside for p in packages)]

    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(2).select("k", P.fw_from_package_json(F.col("text")).alias("f"))
    assert {r.k: r.f for r in df.collect()} == {k: model(t) for k, t in enumerate(texts)}
    assert len(re.findall("(?i)parse_?json", df._jdf.queryExecution().optimizedPlan().toString())) == 1
