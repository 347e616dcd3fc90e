"""Queries over projects, jobs, organizations, events, texts and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar
from ..operators import aggregate as A
from ..operators import detect as D
from ..operators import jobs as J
from ..operators import orgs as O
from ..operators import planning as P
from ..operators import sinks as S
from ..sources import files as SF
from ..sources.shared import folder
from ..sources.stand_in import organizations, subscription_limits, table, transitions
from ..streaming import jobs as ST
from .base import query

# --- scalars -------------------------------------------------------------------------------------------------------


def _pick(names, index):
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


@query("parse_source_type", "SELECT o_orderkey, CASE lower(t) WHEN 'git' THEN 'Git' WHEN 'file_upload' THEN 'FileUpload' WHEN 's3_bucket' THEN 'S3Bucket' WHEN 'directory' THEN 'Directory' END AS source_type FROM (SELECT o_orderkey, (['GIT', 'file_upload', 'S3_Bucket', 'directory', 'svn'])[o_orderkey % 5 + 1] AS t FROM orders)")
def parse_source_type(spark, d):
    t = _pick(("GIT", "file_upload", "S3_Bucket", "directory", "svn"), F.col("o_orderkey") % 5)
    return table(spark, d, "orders").select("o_orderkey", scalar.parse_source_type(t).alias("source_type"))


@query("parse_depth", "SELECT o_orderkey, CASE lower(t) WHEN 'full' THEN 'Full' WHEN 'dependencies_only' THEN 'DependenciesOnly' WHEN 'fast_scan' THEN 'FastScan' END AS depth, CASE lower(t) WHEN 'full' THEN 'deep' WHEN 'dependencies_only' THEN 'quick' WHEN 'fast_scan' THEN 'quick' END AS sast FROM (SELECT o_orderkey, (['FULL', 'dependencies_only', 'Fast_Scan', 'other'])[o_orderkey % 4 + 1] AS t FROM orders)")
def parse_depth(spark, d):
    t = scalar.parse_depth(_pick(("FULL", "dependencies_only", "Fast_Scan", "other"), F.col("o_orderkey") % 4))
    return table(spark, d, "orders").select("o_orderkey", t.alias("depth"), scalar.sast_depth(t).alias("sast"))


_MODULE = "(['DependencyAnalyzer', 'SAST', 'SecretDetection', 'ApiSecurity', 'MaliciousPackageDetection', 'LicenseCompliance', 'SBOM', 'DAST', 'FuzzTesting', 'IaC', 'CSPM'])[{0} % 11 + 1]"


@query("module_bucket", f"SELECT m AS module_type, CASE m WHEN 'SAST' THEN 'sast' WHEN 'SecretDetection' THEN 'secrets' WHEN 'DependencyAnalyzer' THEN 'dependencies' WHEN 'ApiSecurity' THEN 'api' ELSE 'sast' END AS bucket, CASE WHEN m IN ('DependencyAnalyzer', 'SAST', 'SecretDetection', 'ApiSecurity') THEN 'community' ELSE 'enterprise' END AS tier, count(*) AS n FROM (SELECT {_MODULE.format('p_partkey')} AS m FROM part) GROUP BY ALL")
def module_bucket(spark, d):
    m = table(spark, d, "part").select(_pick(schema.MODULES, F.col("p_partkey") % 11).alias("module_type"))
    return m.groupBy("module_type", scalar.module_bucket(F.col("module_type")).alias("bucket"), scalar.tier_of(F.col("module_type")).alias("tier")).agg(F.count("*").alias("n"))


@query("tier_of", f"SELECT CASE WHEN m IN ('DependencyAnalyzer', 'SAST', 'SecretDetection', 'ApiSecurity') THEN 'community' ELSE 'enterprise' END AS tier, count(*) AS n FROM (SELECT {_MODULE.format('p_partkey')} AS m FROM part) GROUP BY ALL")
def tier_of(spark, d):
    m = table(spark, d, "part").select(_pick(schema.MODULES, F.col("p_partkey") % 11).alias("module_type"))
    return m.join(F.broadcast(schema.modules(spark)), "module_type").groupBy("tier").agg(F.count("*").alias("n"))  # eleven rows


@query("policy_ports", "SELECT m, net, CASE WHEN m = 'DependencyAnalyzer' AND net THEN 'dependency_resolution' ELSE 'read_only_analysis' END AS profile, CASE WHEN m = 'DependencyAnalyzer' AND net THEN '80,443,8080,8443' || CASE WHEN cache THEN ',6379' ELSE '' END ELSE '' END AS ports, count(*) AS n FROM (SELECT " + _MODULE.format("p_partkey") + " AS m, p_size % 2 = 0 AS net, p_size % 3 = 0 AS cache FROM part) GROUP BY m, net, profile, ports")
def policy_ports(spark, d):
    m = table(spark, d, "part").select(_pick(schema.MODULES, F.col("p_partkey") % 11).alias("m"), (F.col("p_size") % 2 == 0).alias("net"), (F.col("p_size") % 3 == 0).alias("cache"))
    profile = scalar.policy_profile(F.col("m"), F.col("net"))
    return m.groupBy("m", "net", profile.alias("profile"), F.array_join(scalar.policy_ports(profile, F.col("cache")), ",").alias("ports")).agg(F.count("*").alias("n"))


@query("calc_limits", "SELECT p_partkey, m AS module_type, CAST(greatest(30000, least(600000, 60000 + floor(b / 1048576.0 * 200 * tf))) AS BIGINT) AS timeout_ms, CAST(greatest(536870912, least(8589934592, 1073741824 + floor(b * 10.0 * mf))) AS BIGINT) AS max_memory FROM (SELECT *, CASE m WHEN 'DependencyAnalyzer' THEN 2.5::DOUBLE WHEN 'SAST' THEN 2.0 WHEN 'SecretDetection' THEN 1.0 WHEN 'ApiSecurity' THEN 1.0 ELSE 1.5 END AS tf, CASE m WHEN 'DependencyAnalyzer' THEN 1.5::DOUBLE WHEN 'SAST' THEN 2.0 WHEN 'SecretDetection' THEN 1.0 WHEN 'ApiSecurity' THEN 1.0 ELSE 1.5 END AS mf FROM (SELECT p_partkey, " + _MODULE.format("p_partkey") + " AS m, CAST(p_size * p_partkey * 4096 AS DOUBLE) AS b FROM part))")
def calc_limits(spark, d):
    m = table(spark, d, "part").select("p_partkey", _pick(schema.MODULES, F.col("p_partkey") % 11).alias("module_type"), (F.col("p_size") * F.col("p_partkey") * 4096).alias("b"))
    return m.select("p_partkey", "module_type", scalar.calc_limits(F.col("b"), F.col("module_type")).alias("l")).select("p_partkey", "module_type", "l.*")


@query("parse_s3_uri", "SELECT page_id, uri, CASE kind WHEN 0 THEN 'bucket' || page_id WHEN 1 THEN 'bucket' || page_id WHEN 2 THEN 'bucket' || page_id WHEN 3 THEN 'bucket' || page_id END AS bucket, CASE kind WHEN 0 THEN 'a/b' WHEN 1 THEN 'p' WHEN 3 THEN 'x/y' END AS prefix, CASE kind WHEN 2 THEN 'us-west-2' WHEN 3 THEN 'eu-west-1' END AS region FROM (SELECT page_id, page_id % 6 AS kind, CASE page_id % 6 WHEN 0 THEN 's3://bucket' || page_id || '/a/b' WHEN 1 THEN 'https://bucket' || page_id || '.s3.amazonaws.com/p' WHEN 2 THEN 'https://bucket' || page_id || '.s3.us-west-2.amazonaws.com' WHEN 3 THEN 'https://s3.eu-west-1.amazonaws.com/bucket' || page_id || '/x/y' WHEN 4 THEN 'ftp://bucket' ELSE url END AS uri FROM pages)")
def parse_s3_uri(spark, d):
    k, b = F.col("page_id") % 6, F.concat(F.lit("bucket"), "page_id")
    uri = F.when(k == 0, F.concat(F.lit("s3://"), b, F.lit("/a/b"))).when(k == 1, F.concat(F.lit("https://"), b, F.lit(".s3.amazonaws.com/p"))).when(k == 2, F.concat(F.lit("https://"), b, F.lit(".s3.us-west-2.amazonaws.com"))).when(k == 3, F.concat(F.lit("https://s3.eu-west-1.amazonaws.com/"), b, F.lit("/x/y"))).when(k == 4, F.lit("ftp://bucket")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", uri.alias("uri")).select("page_id", "uri", scalar.parse_s3_uri(F.col("uri")).alias("s")).select("page_id", "uri", "s.*")


@query("redact_url", "SELECT c_custkey, regexp_replace(u, '^(.*?://)?.*@', '\\1***@') AS url FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'postgres://u' || c_custkey || ':p@s@host/db' WHEN 1 THEN 'redis://host/' || c_custkey ELSE 'user' || c_custkey || ':pw@host' END AS u FROM customer)")
def redact_url(spark, d):
    k = F.col("c_custkey")
    u = F.when(k % 3 == 0, F.concat(F.lit("postgres://u"), k, F.lit(":p@s@host/db"))).when(k % 3 == 1, F.concat(F.lit("redis://host/"), k)).otherwise(F.concat(F.lit("user"), k, F.lit(":pw@host")))
    return table(spark, d, "customer").select("c_custkey", scalar.redact_url(u).alias("url"))


@query("cache_stats", "SELECT user_id, hits, misses, CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) / (hits + misses) ELSE 0.0 END AS hit_rate FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM events GROUP BY user_id)")
def cache_stats(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return g.withColumn("hit_rate", scalar.hit_rate(F.col("hits"), F.col("misses")))


@query("hit_rate", "SELECT CAST(hits AS DOUBLE) / (hits + misses) AS hit_rate FROM (SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM events)")
def hit_rate(spark, d):
    g = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return g.select(scalar.hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate"))


@query("key_active", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 3 = 0 OR o_orderdate > TIMESTAMP '1997-01-01')")
def key_active(spark, d):
    revoked = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    expires = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").where(scalar.key_active(revoked, expires, F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey")


@query("ym_check", "SELECT CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y/%m') ELSE strftime(o_orderdate, '%Y-%m') END AS year_month, o_orderkey % 4 <> 0 AS valid, count(*) AS n FROM orders GROUP BY ALL")
def ym_check(spark, d):
    ym = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, d, "orders").groupBy(ym.alias("year_month")).agg(F.count("*").alias("n")).select("year_month", scalar.ym_check(F.col("year_month")).alias("valid"), "n")


@query("meta_merge", "SELECT p_partkey, 'x=' || p_size || ',sandbox.backend=landlock,y=' || p_brand AS info FROM part")
def meta_merge(spark, d):
    own = F.create_map(F.lit("sandbox.backend"), F.lit("none"), F.lit("x"), F.col("p_size").cast("string"), F.lit("y"), F.col("p_brand"))
    extra = F.create_map(F.lit("sandbox.backend"), F.lit("landlock"))
    entries = F.array_sort(F.map_entries(F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(extra, k)), extra)))
    order = F.concat(F.filter(entries, lambda e: e["key"] == "x"), F.filter(entries, lambda e: ~e["key"].isin("x")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(order, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("info"))


@query("det_cwe_norm", "SELECT p_partkey, 'CWE-' || p_partkey AS cwe FROM part")
def det_cwe_norm(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("cwe-0"), k)).otherwise(F.concat(F.lit("CWE"), k))
    return table(spark, d, "part").select("p_partkey", scalar.cwe_norm(raw).alias("cwe"))


# --- planning ------------------------------------------------------------------------------------------------------

_NAMES = ("package.json", "Cargo.toml", "main.rs", "app.py", "manage.py", "react-app.js", "index.ts", "go.mod", "Dockerfile", "README.md", "pom.xml", "x.java", "composer.lock", "yarn.lock", "z.php", "Makefile", "view.tsx")
_FILES = "files AS (SELECT p_partkey % 50 AS project_id, 'src/d' || p_size || '/' || ([" + ", ".join(f"'{n}'" for n in _NAMES) + f"])[p_partkey % {len(_NAMES)} + 1] AS path FROM part)"
_LANG = """CASE WHEN n IN ('package.json', 'yarn.lock') THEN ['javascript'] WHEN n = 'Cargo.toml' THEN ['rust'] WHEN n = 'go.mod' THEN ['go'] WHEN n = 'pom.xml' THEN ['java'] WHEN n = 'composer.lock' THEN ['php'] WHEN n LIKE '%.py' THEN ['python'] WHEN n LIKE '%.js' THEN ['javascript'] WHEN n LIKE '%.ts' OR n LIKE '%.tsx' THEN ['typescript', 'javascript'] WHEN n LIKE '%.rs' THEN ['rust'] WHEN n LIKE '%.java' THEN ['java'] WHEN n LIKE '%.php' THEN ['php'] ELSE [] END"""
_FW = "CASE WHEN n = 'Dockerfile' THEN ['docker'] WHEN n = 'manage.py' THEN ['django'] WHEN n = 'react-app.js' THEN ['react'] ELSE [] END"
_DETECTED = f"WITH {_FILES}, det AS (SELECT *, {_LANG} AS languages, {_FW} AS frameworks, n IN ('package.json', 'yarn.lock', 'Cargo.toml', 'go.mod', 'pom.xml', 'composer.lock') AS dep, n IN ('package.json', 'Cargo.toml', 'go.mod', 'pom.xml', 'Dockerfile') AS conf FROM (SELECT *, split_part(path, '/', 3) AS n FROM files)), proj AS (SELECT project_id, list_sort(list_distinct(flatten(list(languages)))) AS languages, list_sort(list_distinct(flatten(list(frameworks)))) AS frameworks, count(*) FILTER (dep) AS n_dependency_files, count(*) FILTER (conf) AS n_config_files FROM det GROUP BY project_id)"


def _files(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 50).alias("project_id"), F.concat(F.lit("src/d"), "p_size", F.lit("/"), _pick(_NAMES, F.col("p_partkey") % len(_NAMES))).alias("path"))


@query("lang_detect", _DETECTED + " SELECT project_id, path, array_to_string(languages, ',') AS languages, array_to_string(frameworks, ',') AS frameworks, dep AS is_dependency_file, conf AS is_config_file FROM det")
def lang_detect(spark, d):
    return P.lang_detect(_files(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("languages", "frameworks")})


@query("agg_project", _DETECTED + " SELECT project_id, array_to_string(languages, ',') AS languages, array_to_string(frameworks, ',') AS frameworks, n_dependency_files, n_config_files FROM proj")
def agg_project(spark, d):
    return P.agg_project(P.lang_detect(_files(spark, d))).withColumns({c: F.array_join(c, ",") for c in ("languages", "frameworks")})


_DEPTH = "(['Full', 'FastScan', 'DependenciesOnly'])[project_id % 3 + 1]"
_SELECT = _DETECTED + f", sel AS (SELECT project_id, {_DEPTH} AS depth, list_filter(['DependencyAnalyzer', CASE WHEN len(languages) > 0 AND project_id % 3 < 2 THEN 'SAST' END, CASE WHEN project_id % 3 = 0 THEN 'SecretDetection' END, CASE WHEN project_id % 3 = 0 AND (len(languages) > 0 OR list_contains(frameworks, 'django')) THEN 'ApiSecurity' END, CASE WHEN project_id % 3 = 0 THEN 'LicenseCompliance' END, CASE WHEN project_id % 3 = 0 AND list_contains(frameworks, 'docker') THEN 'IaC' END], lambda m: m IS NOT NULL) AS modules FROM proj)"


def _selected(spark, d):
    p = P.agg_project(P.lang_detect(_files(spark, d))).withColumn("depth", _pick(("Full", "FastScan", "DependenciesOnly"), F.col("project_id") % 3))
    return P.module_select(p, (*schema.COMMUNITY, "LicenseCompliance", "IaC"))


@query("module_select", _SELECT + " SELECT project_id, depth, array_to_string(modules, ',') AS modules FROM sel")
def module_select(spark, d):
    return _selected(spark, d).select("project_id", "depth", F.array_join("modules", ",").alias("modules"))


_REG = "('SAST', 'SecretDetection', 'ApiSecurity')"


def _registry(spark):
    return schema.modules(spark).where(F.col("module_type").isin("SAST", "SecretDetection", "ApiSecurity"))


@query("module_available", _SELECT + f" SELECT * FROM (SELECT project_id, unnest(modules) AS module_type FROM sel) WHERE module_type IN {_REG}")
def module_available(spark, d):
    return P.module_available(_selected(spark, d).select("project_id", F.explode("modules").alias("module_type")), _registry(spark))[0]


@query("minus_missing", _SELECT + f" SELECT * FROM (SELECT project_id, unnest(modules) AS module_type FROM sel) WHERE module_type NOT IN {_REG}")
def minus_missing(spark, d):
    return P.module_available(_selected(spark, d).select("project_id", F.explode("modules").alias("module_type")), _registry(spark))[1]


@query("intersect_available", _SELECT + " SELECT project_id, array_to_string(list_filter(modules, lambda m: m IN ('SAST', 'SecretDetection', 'ApiSecurity')), ',') AS modules FROM sel")
def intersect_available(spark, d):
    return _selected(spark, d).select("project_id", F.array_join(F.array_intersect("modules", F.array(*map(F.lit, ("SAST", "SecretDetection", "ApiSecurity")))), ",").alias("modules"))


@query("registry_filter", "SELECT * FROM (VALUES ('DependencyAnalyzer', 0), ('SAST', 1), ('SecretDetection', 2), ('ApiSecurity', 3)) t(module_type, ord)")
def registry_filter(spark, d):
    return schema.modules(spark).where("tier = 'community'").select("module_type", "ord")


@query("join_registry", _SELECT + f", w AS (SELECT project_id AS job_id, unnest(modules) AS module_type FROM sel) SELECT job_id, module_type, CASE WHEN module_type NOT IN {_REG} THEN 'no result: ' || module_type WHEN job_id % 4 = 0 THEN 'timeout' END AS error FROM w")
def join_registry(spark, d):
    w = _selected(spark, d).select(F.col("project_id").alias("job_id"), F.explode("modules").alias("module_type"))
    done = w.join(_registry(spark), "module_type", "left_semi").withColumn("error", F.when(F.col("job_id") % 4 == 0, "timeout"))
    return P.join_registry(done, w)


@query("fw_from_package_json", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'react,nextjs' WHEN 1 THEN 'react' WHEN 2 THEN 'angular,svelte' ELSE '' END AS frameworks FROM part")
def fw_from_package_json(spark, d):
    text = _pick(('{"dependencies":{"react":"18","next":"1"}}', '{"devDependencies":{"react-dom":"1"},"x":1}', '{"peerDependencies":{"@angular/core":null},"optionalDependencies":{"@sveltejs/kit":"1"}}', "not json", '{"dependencies":["react"]}', '"react"'), F.col("p_partkey") % 6)
    return table(spark, d, "part").select("p_partkey", F.array_join(P.fw_from_package_json(text), ",").alias("frameworks"))


@query("det_dyn_depth", "SELECT p_partkey, CASE WHEN p_partkey % 1000 > 500 OR p_size * 2000000 > 52428800 THEN (['standard', 'quick', 'quick'])[p_partkey % 3 + 1] ELSE (['deep', 'standard', 'quick'])[p_partkey % 3 + 1] END AS depth FROM part")
def det_dyn_depth(spark, d):
    p = table(spark, d, "part").select("p_partkey", _pick(("deep", "standard", "quick"), F.col("p_partkey") % 3).alias("depth"), (F.col("p_partkey") % 1000).alias("files"), (F.col("p_size").cast("long") * 2000000).alias("bytes"))
    return D.dyn_depth(p).select("p_partkey", "depth")


# --- files, shards, caches -----------------------------------------------------------------------------------------


def _tree(spark):
    root = folder(spark, "tree-")
    disk, base = SF.open_root(root)
    for path, n in (("a.py", 3), ("src/b.rs", 5), (".hidden", 7), ("node_modules/c.js", 11), ("d1/d2/d3/d4/e.go", 13), ("d1/d2/d3/d4/d5/f.go", 17), ("dist/g.js", 19)):
        disk.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
        with disk.open_output_stream(f"{base}/{path}") as f:
            f.write(b"x" * n)
    return root


@query("scan_dir", "SELECT * FROM (VALUES ('a.py', CAST(3 AS BIGINT)), ('src/b.rs', 5), ('d1/d2/d3/d4/e.go', 13), ('dist/g.js', 19)) t(path, length)")
def scan_dir(spark, d):
    return SF.scan_dir(spark, _tree(spark))


@query("scan_size", "SELECT CAST(3 + 5 + 7 + 13 + 17 AS BIGINT) AS bytes")
def scan_size(spark, d):
    return SF.scan_size(spark, _tree(spark))


@query("agg_size", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY p_brand")
def agg_size(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("bytes"))


_CAP = """WITH RECURSIVE o AS (SELECT p_brand AS bucket, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS key, CAST(p_size AS BIGINT) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
f AS (SELECT bucket, key, size, k, size <= 400 AS takes, CASE WHEN size <= 400 THEN size ELSE 0 END AS bytes, CASE WHEN size <= 400 THEN 1 ELSE 0 END AS n FROM o WHERE k = 1
UNION ALL SELECT o.bucket, o.key, o.size, o.k, f.n < 20 AND f.bytes + o.size <= 400, f.bytes + CASE WHEN f.n < 20 AND f.bytes + o.size <= 400 THEN o.size ELSE 0 END, f.n + CASE WHEN f.n < 20 AND f.bytes + o.size <= 400 THEN 1 ELSE 0 END FROM f JOIN o ON o.bucket = f.bucket AND o.k = f.k + 1)
SELECT bucket, key, size FROM f WHERE takes"""


@query("win_cap", _CAP)
def win_cap(spark, d):
    o = table(spark, d, "part").select(F.col("p_brand").alias("bucket"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("key"), F.col("p_size").alias("size"))
    return J.win_cap(o, "bucket", 20, 400)


_LPT = """WITH RECURSIVE f AS (SELECT p_brand, 'a/b' || p_partkey AS path, CAST(p_size AS BIGINT) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, string_split('a/b' || p_partkey, '/')) AS k, least(count(*) OVER (PARTITION BY p_brand), 4) AS n FROM part),
s AS (SELECT p_brand, k, path, size, CAST(0 AS BIGINT) AS shard, list_transform(range(0, n), lambda i: CASE WHEN i = 0 THEN size ELSE 0 END) AS loads FROM f WHERE k = 1
UNION ALL SELECT f.p_brand, f.k, f.path, f.size, CAST(list_position(s.loads, list_min(s.loads)) - 1 AS BIGINT), list_transform(s.loads, lambda v, i: v + CASE WHEN i = list_position(s.loads, list_min(s.loads)) THEN f.size ELSE 0 END) FROM s JOIN f ON f.p_brand = s.p_brand AND f.k = s.k + 1)
SELECT p_brand, CAST(shard AS INTEGER) AS shard, path, size FROM s"""


@query("shard_lpt", _LPT)
def shard_lpt(spark, d):
    f = table(spark, d, "part").select("p_brand", F.concat(F.lit("a/b"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("size"))
    return J.shard_lpt(f, "p_brand", 4)


@query("sort_candidates", "SELECT 'd' || p_size || '/f' || p_partkey AS path, p_size AS size FROM part ORDER BY p_size DESC, string_split(path, '/')")
def sort_candidates(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("d"), "p_size", F.lit("/f"), "p_partkey").alias("path"), F.col("p_size").alias("size"))
    return p.orderBy(F.desc("size"), F.split("path", "/"))


def _writes(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("job:snapshot:"), "user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("value"))


_LATEST = "WITH w AS (SELECT 'job:snapshot:' || user_id AS key, ts, event_id, event_type AS value FROM events), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)"


@query("kv_set", _LATEST + " SELECT * FROM l")
def kv_set(spark, d):
    return J.latest(_writes(spark, d), "key", [F.col("ts"), F.col("event_id")])


@query("win_latest", _LATEST + " SELECT key, value FROM l")
def win_latest(spark, d):
    return kv_set(spark, d).select("key", "value")


@query("kv_get", _LATEST + " SELECT * FROM l WHERE key = 'job:snapshot:7'")
def kv_get(spark, d):
    return J.get(kv_set(spark, d), "key", "job:snapshot:7")


@query("kv_del", _LATEST + " SELECT * FROM l WHERE key NOT IN (SELECT 'job:snapshot:' || c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def kv_del(spark, d):
    gone = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("job:snapshot:"), "c_custkey").alias("key"))
    return J.delete(kv_set(spark, d), gone, "key")


@query("kv_del_pattern", _LATEST + " SELECT * FROM l WHERE NOT regexp_matches(key, '^job:snapshot:1.*$')")
def kv_del_pattern(spark, d):
    return kv_set(spark, d).where(~F.col("key").rlike(scalar.glob_regex("job:snapshot:1*")))


@query("kv_ttl", _LATEST + " SELECT key FROM l WHERE epoch(TIMESTAMP '2024-01-31') - epoch(ts) < 86400 * 2")
def kv_ttl(spark, d):
    return J.alive(kv_set(spark, d), "ts", 86400 * 2, F.lit("2024-01-31").cast("timestamp")).select("key")


@query("cache_tiered", _LATEST + ", a AS (SELECT * FROM l WHERE event_id % 2 = 0), b AS (SELECT * FROM l WHERE event_id % 3 = 0) SELECT key, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 1 ELSE 2 END AS tier FROM a FULL JOIN b USING (key)")
def cache_tiered(spark, d):
    rows = kv_set(spark, d)
    return J.read_through(rows.where("event_id % 2 = 0"), rows.where("event_id % 3 = 0"), "key", "value")


@query("codec_gzip", "SELECT doc_id, strlen(text) >= 10240 AS compressed, true AS round_trip FROM documents")
def codec_gzip(spark, d):
    kind = F.pandas_udf(S.codec_gzip(), "binary")
    back = F.pandas_udf(S.decode_gzip, "binary")
    x = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw")).withColumn("stored", kind("raw"))
    return x.select("doc_id", (F.substring("stored", 1, 4) == F.encode(F.lit("GZP_"), "UTF-8")).alias("compressed"), (back("stored") == F.col("raw")).alias("round_trip"))


@query("sink_webhook")
def sink_webhook(spark, d):
    body = F.to_json(F.struct(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status")))
    return S.sign(table(spark, d, "orders").select(F.unix_timestamp("o_orderdate").cast("string").alias("ts"), body.alias("body")), "secret")


@query("export_csv_json", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def export_csv_json(spark, d):
    out = folder(spark, "export-")
    kind = "o_orderstatus string, n long"
    table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).write.mode("overwrite").option("header", True).csv(f"{out}/csv")
    csv = spark.read.schema(kind).option("header", True).csv(f"{out}/csv")
    csv.write.mode("overwrite").json(f"{out}/json")
    return spark.read.schema(kind).json(f"{out}/json")


# --- jobs ----------------------------------------------------------------------------------------------------------


@query("sm_validate", ", e AS (SELECT to_status, lag(to_status, 1, 'Pending') OVER (PARTITION BY job_id ORDER BY seq) AS from_status FROM requests) SELECT from_status, to_status, (from_status, to_status) IN (('Pending', 'Queued'), ('Pending', 'Cancelled'), ('Queued', 'Running'), ('Queued', 'Cancelled'), ('Running', 'Completed'), ('Running', 'Failed')) AS valid, count(*) AS n FROM e GROUP BY ALL", "requests")
def sm_validate(spark, d):
    w = Window.partitionBy("job_id").orderBy("seq")
    e = transitions(spark, d).withColumn("from_status", F.lag("to_status", 1, "Pending").over(w))
    return J.sm_validate(e).groupBy("from_status", "to_status", "valid").agg(F.count("*").alias("n"))


@query("sm_apply", " SELECT job_id, CASE max(to_status) FILTER (seq = 3) WHEN 'Cancelled' THEN 'Running' ELSE max(to_status) FILTER (seq = 3) END AS status, max(ts) FILTER (seq = 2) AS started_at, CASE WHEN max(to_status) FILTER (seq = 3) <> 'Cancelled' THEN max(ts) FILTER (seq = 3) END AS completed_at, CASE WHEN max(to_status) FILTER (seq = 3) = 'Cancelled' THEN CAST(2 AS INTEGER) ELSE CAST(3 AS INTEGER) END AS applied FROM requests GROUP BY job_id", "requests")
def sm_apply(spark, d):
    return J.sm_apply(transitions(spark, d).groupBy("job_id", "seq").agg(F.max("to_status").alias("to_status"), F.max("ts").alias("ts")))


@query("sm_finding", "SELECT CAST(4 AS BIGINT) AS valid_edges")
def sm_finding(spark, d):
    s = ("Open", "In Progress", "Resolved", "False Positive", "Acknowledged")
    pairs = spark.createDataFrame([(a, b) for a in s for b in s], "from_status string, to_status string")
    return J.sm_validate(pairs, schema.FINDING_EDGES).agg(F.count_if("valid").alias("valid_edges"))


@query("win_transition", " SELECT job_id, seq, to_status, lag(to_status) OVER w AS from_status, CAST(epoch(ts) - epoch(lag(ts) OVER w) AS BIGINT) AS seconds FROM requests WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)", "requests")
def win_transition(spark, d):
    return J.win_transition(transitions(spark, d)).select("job_id", "seq", "to_status", "from_status", "seconds")


@query("status_ok", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'Failed' ELSE 'Completed' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_ok(spark, d):
    e = F.when(F.col("o_orderstatus") == "F", "error")
    return table(spark, d, "orders").groupBy(scalar.status_of(e).alias("status")).agg(F.count("*").alias("n"))


@query("agg_scans", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS completed, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY o_custkey")
def agg_scans(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("completed"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("recent_scans", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_scans(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("wf_get", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def wf_get(spark, d):
    return J.get(table(spark, d, "orders"), "o_orderkey", 42).select("o_orderkey", "o_orderstatus")


@query("wf_persist", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Running' ELSE o_orderstatus END AS status FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders)")
def wf_persist(spark, d):
    store = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).distinct()
    return J.put(store, store.where("o_orderkey % 2 = 0").withColumn("status", F.lit("Running")), "o_orderkey")


# --- organizations -------------------------------------------------------------------------------------------------

_WALK = ", walk AS (SELECT o.id, o.id AS cur, 0 AS depth FROM organizations o UNION ALL SELECT w.id, o.parent_id, w.depth + 1 FROM walk w JOIN organizations o ON o.id = w.cur JOIN subscription_limits s ON s.organization_id = w.cur WHERE s.inherit_limits AND w.depth < 10 AND o.parent_id IS NOT NULL), top AS (SELECT id, cur FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1)"


@query("hier_limits", _WALK + " SELECT t.id, s.organization_id, s.tier, s.max_scans_monthly, s.max_api_calls_monthly FROM top t LEFT JOIN subscription_limits s ON s.organization_id = t.cur", "orgs")
def hier_limits(spark, d):
    return O.hier_limits(organizations(spark, d), subscription_limits(spark, d))


@query("view_effective", _WALK + " SELECT o.id, o.name, o.parent_id, coalesce(s.tier, 'free') AS effective_tier, coalesce(s.max_scans_monthly, 5) AS effective_max_scans_monthly, coalesce(s.max_api_calls_monthly, 1000) AS effective_max_api_calls_monthly FROM organizations o JOIN top t USING (id) LEFT JOIN subscription_limits s ON s.organization_id = t.cur", "orgs")
def view_effective(spark, d):
    return O.view_effective(organizations(spark, d), subscription_limits(spark, d))


@query("join_org_limits", " SELECT o.id, o.name, s.tier FROM organizations o LEFT JOIN subscription_limits s ON s.organization_id = o.id", "orgs")
def join_org_limits(spark, d):
    o, s = organizations(spark, d), subscription_limits(spark, d)
    return o.join(s, o["id"] == s["organization_id"], "left").select("id", "name", "tier")


@query("insert_default_limits", " SELECT organization_id, tier, max_scans_monthly FROM subscription_limits UNION ALL SELECT id, 'free', 5 FROM organizations WHERE id NOT IN (SELECT organization_id FROM subscription_limits)", "orgs")
def insert_default_limits(spark, d):
    return O.insert_default_limits(organizations(spark, d), subscription_limits(spark, d)).select("organization_id", "tier", "max_scans_monthly")


@query("join_fk", "SELECT r_name, n_name, count(*) AS jobs FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_fk(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    by = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("jobs"))
    return by.join(n, by["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name", "jobs")


@query("cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return O.cascade_delete(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("set_null", "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def set_null(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return O.set_null(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("agg_api_usage", "SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type")
def agg_api_usage(spark, d):
    return A.share(table(spark, d, "events"), "event_type")


@query("win_cum_quota", "SELECT *, round(least(used * 100.0 / 500, 100.0), 6) AS pct, CASE WHEN used >= 500 THEN 100 WHEN used >= 450 THEN 90 WHEN used >= 375 THEN 75 WHEN used >= 250 THEN 50 ELSE 0 END AS level FROM (SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS used FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL))")
def win_cum_quota(spark, d):
    use = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return O.win_cum_quota(use, "user_id", "day", "n", F.lit(500))


@query("audit_log", "SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def audit_log(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "event_type")


@query("event_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def event_retention(spark, d):
    return ST.retain(table(spark, d, "events"), F.lit("2024-01-20").cast("date"), 10).select("event_id")


_EDGES = "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey * 2 % 1000 + 1000 AS dst FROM part WHERE p_partkey < 1000 UNION SELECT DISTINCT p_partkey, p_partkey + 500 FROM part WHERE p_partkey BETWEEN 1000 AND 1400)"


def _edges(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey < 1000").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2 % 1000 + 1000).alias("dst"))
    return a.union(p.where("p_partkey BETWEEN 1000 AND 1400").select("p_partkey", F.col("p_partkey") + 500)).distinct()


@query("dep_graph", _EDGES + ", r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.dst WHERE r.depth < 3) SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY src, dst")
def dep_graph(spark, d):
    return O.closure(_edges(spark, d), 3)


@query("taint_path", _EDGES + ", r AS (SELECT src, dst, 1 AS depth FROM e WHERE src < 100 UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.dst WHERE r.depth < 3) SELECT DISTINCT src, dst FROM r WHERE dst >= 1500")
def taint_path(spark, d):
    e = _edges(spark, d)
    return O.closure(e, 3, e.where("src < 100").select("src")).where("dst >= 1500").select("src", "dst")


@query("topo_sort", _EDGES + ", p AS (SELECT src AS node, 0 AS level FROM e UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON e.src = p.node WHERE p.level < 4) SELECT node, CAST(max(level) AS INTEGER) AS level FROM p GROUP BY node")
def topo_sort(spark, d):
    return O.topo_levels(_edges(spark, d), 4)


# --- texts ---------------------------------------------------------------------------------------------------------


@query("det_regex", "SELECT doc_id, rule_id, severity, m AS match FROM (" + " UNION ALL ".join("SELECT doc_id, '{0}' AS rule_id, '{2}' AS severity, unnest(regexp_extract_all(text, '{1}')) AS m FROM documents".format(r, p.replace("'", "''"), s) for r, p, s in D.SECRET_RULES) + ")")
def det_regex(spark, d):
    return D.det_regex(table(spark, d, "documents"), "doc_id", "text")


_TOKENS = "t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z+/=_-]{20,}')) AS token FROM documents), h AS (SELECT doc_id, token, CASE WHEN regexp_matches(token, '^[0-9a-fA-F]+$') THEN 'hex' ELSE 'base64' END AS kind FROM t), c AS (SELECT doc_id, token, kind, ch, count(*) AS n FROM (SELECT *, unnest(string_split(token, '')) AS ch FROM h) GROUP BY ALL), s AS (SELECT doc_id, token, kind, round(abs(sum(-(n / length(token)) * log2(n / length(token)))), 6) AS entropy FROM c GROUP BY ALL)"


@query("det_entropy", "WITH " + _TOKENS + " SELECT * FROM s WHERE entropy >= CASE WHEN kind = 'hex' THEN 3.0 ELSE 4.5 END")
def det_entropy(spark, d):
    return D.det_entropy(table(spark, d, "documents"), "doc_id", "text")


@query("det_mask", "WITH " + _TOKENS + " SELECT doc_id, token[1:4] || '****' AS masked FROM s WHERE kind = 'hex' AND entropy >= 3.0")
def det_mask(spark, d):
    return D.det_entropy(table(spark, d, "documents"), "doc_id", "text").where("kind = 'hex'").select("doc_id", scalar.mask(F.col("token")).alias("masked"))


@query("det_rules", "SELECT page_id, 'script-tag' AS rule_id, 'Medium' AS severity, unnest(regexp_extract_all(html, '<script[^>]*>')) AS match FROM pages")
def det_rules(spark, d):
    return D.det_regex(table(spark, d, "pages"), "page_id", "html", (("script-tag", "<script[^>]*>", "Medium"),))


@query("changed_only", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0")
def changed_only(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("hash"))
    return D.changed_only(docs, known, "doc_id", "text").select("doc_id", "hash")


@query("quality_gate", "WITH f AS (SELECT d.doc_id AS key, d.lang FROM documents d WHERE n_chars % 2 = 0), e AS (SELECT d.doc_id AS key, d.lang FROM documents d JOIN labels USING (doc_id) WHERE quality = 1), j AS (SELECT coalesce(f.lang, e.lang) AS lang, f.key IS NOT NULL AS f, e.key IS NOT NULL AS e FROM f FULL JOIN e ON f.key = e.key AND f.lang = e.lang), c AS (SELECT lang, count(*) FILTER (f AND e) AS tp, count(*) FILTER (f AND NOT e) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM j GROUP BY lang) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, tp / (tp + fp) >= 0.7 AND tp / (tp + fn) >= 0.5 AS passed FROM c")
def quality_gate(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "lang", "n_chars")
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    return A.quality_gate(docs.where("n_chars % 2 = 0").select("key", "lang"), docs.join(good, "key", "left_semi").select("key", "lang"), "lang")


# --- streams -------------------------------------------------------------------------------------------------------

_COST = "CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 6 ELSE 1 END"


@query("rate_limit", f"SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(sum({_COST}) AS BIGINT) AS cost, sum({_COST}) > 6 AS limited FROM events GROUP BY ALL")
def rate_limit(spark, d):
    return ST.rate_limit(table(spark, d, "events"), 6)


_BUCKET = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, CAST({_COST} AS DOUBLE) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT user_id, event_id, us, k, CASE WHEN 10 >= c THEN CAST(10 AS DOUBLE) - c ELSE CAST(10 AS DOUBLE) END AS tokens, 10 >= c AS allowed FROM e WHERE k = 1
UNION ALL SELECT user_id, event_id, us, k, CASE WHEN held >= c THEN held - c ELSE held END, held >= c FROM (SELECT e.*, least(CAST(10 AS DOUBLE), b.tokens + CAST(e.us - b.us AS DOUBLE) / 1e6 * CAST(0.001 AS DOUBLE)) AS held FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))
SELECT user_id, event_id, allowed FROM b"""


@query("token_bucket", _BUCKET)
def token_bucket(spark, d):
    return ST.token_bucket(table(spark, d, "events"), 10, 0.001)


def _stream(spark, d, name):
    """The table as a stream of one file, in a folder of its own."""
    root = folder(spark, "stream-")
    src = table(spark, d, name)
    src.write.mode("overwrite").parquet(f"{root}/in")
    return root, ST.queue(spark, f"{root}/in", src.schema)


def _drained(spark, stream, folder, mode="append"):
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).trigger(availableNow=True).start()
    q.awaitTermination()  # without a limit: the stream ends by itself, and an earlier read would lose rows
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("src_queue", "SELECT o_orderkey, o_orderstatus FROM orders")
def src_queue(spark, d):
    folder, s = _stream(spark, d, "orders")
    return _drained(spark, s.select("o_orderkey", "o_orderstatus"), folder)


@query("stream_rate_limit", f"SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(sum({_COST}) AS BIGINT) AS cost, sum({_COST}) > 6 AS limited FROM events GROUP BY ALL")
def stream_rate_limit(spark, d):
    folder, s = _stream(spark, d, "events")
    return _drained(spark, ST.rate_limit(s, 6, late="3650 days"), folder, "complete")


@query("stream_lifecycle", ", t AS (SELECT job_id, seq, to_status, max(to_status) FILTER (seq = 3) OVER (PARTITION BY job_id) AS third FROM requests WHERE job_id % 10 = 0) SELECT job_id, seq, CASE seq WHEN 1 THEN 'Pending' WHEN 2 THEN 'Queued' WHEN 3 THEN 'Running' ELSE CASE third WHEN 'Cancelled' THEN 'Running' ELSE third END END AS from_status, to_status, seq < 3 OR (seq = 3 AND third <> 'Cancelled') AS applied FROM t", "requests")
def stream_lifecycle(spark, d):
    root = folder(spark, "stream-")
    src = transitions(spark, d).where("job_id % 10 = 0").select("job_id", F.col("seq").cast("int").alias("seq"), "to_status", "ts")
    src.write.mode("overwrite").parquet(f"{root}/in")
    # With a state time-out a stream goes on with empty batches, to look for what has timed out, and wouldn't end.
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return _drained(spark, ST.lifecycle(ST.queue(spark, f"{root}/in", src.schema, 1000)), root).select("job_id", "seq", "from_status", "to_status", "applied")
    finally:
        spark.conf.set(name, before)
