"""Scalar functions as Catalyst expressions; none runs Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def _case(c: Column, table: dict, default=None) -> Column:
    out = reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), F.lit(None)))
    return out.otherwise(default) if default is not None else out


def sev_rank(c: Column) -> Column:
    """0 (Critical) to 4 (Info); null for an unknown severity.  The higher severity has the smaller rank."""
    return _case(c, {s: F.lit(k) for k, s in enumerate(schema.SEVERITIES)})


def sev_score(c: Column) -> Column:
    return _case(c, {s: F.lit(v) for s, v in schema.SEVERITY_SCORES.items()}, F.lit(0))


def conf_score(c: Column) -> Column:
    return _case(c, {s: F.lit(v) for s, v in schema.CONFIDENCE_SCORES.items()}, F.lit(0))


def conf_rank(c: Column) -> Column:
    return _case(c, {s: F.lit(k) for k, s in enumerate(schema.CONFIDENCES)})


def sev_higher(new: Column, current: Column) -> Column:
    """Whether ``new`` is more severe; an unknown current severity counts as Info."""
    return sev_rank(new) < F.coalesce(sev_rank(current), F.lit(4))


def sarif_level(c: Column) -> Column:
    return F.when(c.isin("Critical", "High"), "error").when(c == "Medium", "warning").when(c.isin("Low", "Info"), "note")


def module_bucket(c: Column) -> Column:
    return _case(c, {m: F.lit(b) for m, b in schema.BUCKETS.items()}, F.lit("sast"))


def tier_of(c: Column) -> Column:
    return F.when(c.isin(*schema.COMMUNITY), "community").when(c.isin(*schema.ENTERPRISE), "enterprise")


def status_of(error: Column) -> Column:
    return F.when(error.isNull(), "Completed").otherwise("Failed")


def parse_source_type(c: Column) -> Column:
    """Case-insensitive; null for anything unknown."""
    return _case(F.lower(c), {"git": F.lit("Git"), "file_upload": F.lit("FileUpload"), "s3_bucket": F.lit("S3Bucket"), "directory": F.lit("Directory")})


def parse_depth(c: Column) -> Column:
    """Case-insensitive; null for anything unknown."""
    return _case(F.lower(c), {"full": F.lit("Full"), "dependencies_only": F.lit("DependenciesOnly"), "fast_scan": F.lit("FastScan")})


def sast_depth(c: Column) -> Column:
    return F.when(c == "Full", "deep").when(c.isin("FastScan", "DependenciesOnly"), "quick")


def policy_profile(module: Column, allow_network: Column) -> Column:
    return F.when((module == "DependencyAnalyzer") & allow_network, "dependency_resolution").otherwise("read_only_analysis")


def policy_ports(profile: Column, cache_port: Column, before: Column | None = None) -> Column:
    """Allowed ports: none for read-only analysis; otherwise those already set, the web ports and maybe the cache's."""
    none = F.array().cast("array<int>")
    web = F.array(*[F.lit(p) for p in (80, 443, 8080, 8443)])
    opened = F.array_union(none if before is None else before, web)
    return F.when(profile == "dependency_resolution", F.when(cache_port, F.array_union(opened, F.array(F.lit(6379)))).otherwise(opened)).otherwise(none)


def dep_parse(path: Column) -> Column:
    """struct(ecosystem, package, version): split at the first ':' and then the first '@'; unknown if either is absent."""
    colon = F.instr(path, ":")
    rest = F.substr(path, colon + F.lit(1))
    at = F.instr(rest, "@")
    whole = (colon > 0) & (at > 0)
    unknown = F.lit("unknown")
    return F.struct(
        F.when(whole, F.substr(path, F.lit(1), colon - 1)).otherwise(unknown).alias("ecosystem"),
        F.when(whole, F.substr(rest, F.lit(1), at - 1)).otherwise(path).alias("package"),
        F.when(whole, F.substr(rest, at + F.lit(1))).otherwise(unknown).alias("version"),
    )


def json_reco(rec: Column) -> Column:
    """struct(is_json, nearest_safe, latest_safe) of a recommendation.

    Only string members of a JSON object count; other valid JSON gives nothing; text that is no JSON is nearest_safe.
    """
    value = F.try_parse_json(rec)

    def member(name: str) -> Column:
        part = F.try_variant_get(value, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))

    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.struct(
        value.isNotNull().alias("is_json"),
        F.when(is_object, member("nearest_safe")).when(value.isNull(), rec).alias("nearest_safe"),
        F.when(is_object, member("latest_safe")).alias("latest_safe"),
    )


def fmt_summary(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" vulnerabilities found"))


def redact_url(url: Column) -> Column:
    """Keep the scheme, put *** for everything up to the last '@'; unchanged without '@'."""
    return F.regexp_replace(url, "^(.*?://)?.*@", "$1***@")


def hit_rate(hits: Column, misses: Column) -> Column:
    total = hits + misses
    return F.when(total > 0, hits.cast("double") / total).otherwise(F.lit(0.0))


def key_active(revoked: Column, expires: Column, now: Column) -> Column:
    return revoked.isNull() & (expires.isNull() | (expires > now))


def ym_check(c: Column) -> Column:
    return c.rlike("^[0-9]{4}-[0-9]{2}$")


def calc_limits(size: Column, module: Column, dynamic: bool = True, timeout_ms: int = 60_000, memory: int = 1 << 30, per_mb_ms: int = 200, ratio: float = 10.0, cap: int = 8 << 30) -> Column:
    """struct(timeout_ms, max_memory) of a module run over ``size`` bytes (null counts as 0)."""
    if not dynamic:
        return F.struct(F.lit(timeout_ms).cast("long").alias("timeout_ms"), F.lit(memory).cast("long").alias("max_memory"))
    b = F.coalesce(size, F.lit(0)).cast("double")
    tf = _case(module, {"DependencyAnalyzer": F.lit(2.5), "SAST": F.lit(2.0), "SecretDetection": F.lit(1.0), "ApiSecurity": F.lit(1.0)}, F.lit(1.5))
    mf = _case(module, {"DependencyAnalyzer": F.lit(1.5), "SAST": F.lit(2.0), "SecretDetection": F.lit(1.0), "ApiSecurity": F.lit(1.0)}, F.lit(1.5))
    time = F.lit(timeout_ms).cast("long") + F.floor(b / (1024.0 * 1024.0) * per_mb_ms * tf)
    mem = F.lit(memory).cast("long") + F.floor(b * ratio * mf)
    return F.struct(F.greatest(F.lit(30_000).cast("long"), F.least(F.lit(600_000).cast("long"), time)).alias("timeout_ms"), F.greatest(F.lit(512 << 20).cast("long"), F.least(F.lit(cap).cast("long"), mem)).alias("max_memory"))


def parse_s3_uri(uri: Column) -> Column:
    """struct(bucket, prefix, region); bucket is null for what is no S3 address."""
    def some(c: Column) -> Column:
        return F.when(c != "", c)

    native = "^s3://([^/]+)(?:/(.*))?$"
    host = "^https?://(?:[^/@]*@)?([^/:?#]+)[^/?#]*/?([^?#]*)"
    name, path = F.regexp_extract(uri, host, 1), F.regexp_replace(F.regexp_extract(uri, host, 2), "^/+", "")
    parts = F.split(name, "\\.")
    n = F.size(parts)
    amazon = name.endswith(".amazonaws.com")
    virtual = amazon & (n >= 4) & (F.get(parts, F.lit(1)) == "s3")
    styled = amazon & ~virtual & (n >= 3) & (F.get(parts, F.lit(0)) == "s3") & (F.substring_index(path, "/", 1) != "")
    s3 = uri.rlike(native)
    return F.struct(
        F.when(s3, F.regexp_extract(uri, native, 1)).when(virtual, F.get(parts, F.lit(0))).when(styled, F.substring_index(path, "/", 1)).alias("bucket"),
        some(F.when(s3, F.regexp_extract(uri, native, 2)).when(virtual, path).when(styled, F.regexp_extract(path, "^[^/]*/(.*)$", 1))).alias("prefix"),
        F.when(virtual & (n == 5), F.get(parts, F.lit(2))).when(styled & (n == 4), F.get(parts, F.lit(1))).alias("region"),
    )


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: ** any, * within a component, ? one character."""
    out, k = "", 0
    while k < len(pattern):
        if pattern[k : k + 2] == "**":
            out, k = out + ".*", k + 2
            continue
        ch = pattern[k]
        out += "[^/]*" if ch == "*" else "[^/]" if ch == "?" else ch if ch.isalnum() or ch in "_/-" else "\\" + ch
        k += 1
    return f"^{out}$"


def cwe_norm(c: Column) -> Column:
    """'79', 'cwe79' and 'CWE-079' become 'CWE-79'; anything else null."""
    digits = F.regexp_extract(F.upper(F.trim(c)), "^(?:CWE[-_ ]?)?0*([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits))


def entropy(token: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty token."""
    n = F.length(token)
    terms = F.transform(F.array_distinct(F.split(token, "")), lambda ch: F.when(ch == "", F.lit(0.0)).otherwise(_term((n - F.length(F.replace(token, ch, F.lit("")))).cast("double") / n)))
    return F.when(n > 0, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))).otherwise(F.lit(0.0))


def _term(p: Column) -> Column:
    return -p * F.log2(p)


def mask(token: Column) -> Column:
    """First four characters and four stars."""
    return F.concat(F.substring(token, 1, 4), F.lit("****"))


def version_key(version: Column) -> Column:
    """Array that orders versions: the first three numeric parts, whether it is a release (1) or comes before it (0), and
    the number in the pre-release tag.  A missing part is 0; no digit at all is null; build metadata doesn't count."""
    core = F.regexp_extract(version, "^[vV=]?([0-9]+(?:\\.[0-9]+)*)", 1)
    tag = F.regexp_extract(version, "^[vV=]?[0-9]+(?:\\.[0-9]+)*-([0-9A-Za-z.-]+)", 1)
    number = lambda p: F.try_to_number(p, F.lit("9999999999")).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = F.slice(F.concat(F.transform(F.split(core, "\\."), number), F.array(zero, zero)), 1, 3)
    rest = F.array(F.when(tag == "", one).otherwise(zero), F.coalesce(F.when(tag != "", number(F.regexp_extract(tag, "([0-9]+)[^0-9]*$", 1))), zero))
    return F.when(core != "", F.concat(parts, rest))


def is_prerelease(version: Column) -> Column:
    return version.rlike("^[vV=]?[0-9]+(\\.[0-9]+)*-")


def version_impact(old: Column, new: Column) -> Column:
    """major, minor or patch by the first part that differs; unknown if either has no numbers; none if equal."""
    a, b = version_key(old), version_key(new)
    at = lambda c, k: F.get(c, F.lit(k))
    return F.when(a.isNull() | b.isNull(), "unknown").when(at(a, 0) != at(b, 0), "major").when(at(a, 1) != at(b, 1), "minor").when(at(a, 2) != at(b, 2), "patch").otherwise("none")
