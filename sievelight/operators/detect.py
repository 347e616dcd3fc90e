"""Detectors over text, their filters, advisory matching and baselines.

Rules are regular expressions over text; there is no syntax tree, and nothing is verified over a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

#: (rule, pattern, severity): own patterns for well-known public credential formats.
SECRET_RULES = (
    ("aws-access-key", "\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b", "Critical"),
    ("github-token", "\\bgh[pousr]_[0-9A-Za-z]{36}\\b", "Critical"),
    ("gitlab-token", "\\bglpat-[0-9A-Za-z_-]{20}\\b", "Critical"),
    ("slack-token", "\\bxox[abprs]-[0-9A-Za-z-]{10,72}\\b", "High"),
    ("jwt", "\\beyJ[0-9A-Za-z_-]{8,}\\.eyJ[0-9A-Za-z_-]{8,}\\.[0-9A-Za-z_-]{8,}", "High"),
    ("private-key", "-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "Critical"),
    ("database-url", "\\b(?:postgres|postgresql|mysql|mongodb|redis)://[^\\s:@/]+:[^\\s@/]+@[^\\s/]+", "High"),
    ("stripe-key", "\\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\\b", "Critical"),
    ("google-api-key", "\\bAIza[0-9A-Za-z_-]{35}", "High"),
    ("npm-token", "\\bnpm_[0-9A-Za-z]{36}\\b", "High"),
    ("generic-token", "\\b(?:token|secret|password|api_key) *[=:] *\"?[0-9a-fA-F]{32,64}\"?", "High"),
    ("aws-secret-key", "(?i)aws_?secret_?(?:access_?)?key *[=:] *[\"']?[0-9A-Za-z/+=]{40}", "Critical"),
    ("aws-session-token", "(?i)aws_?session_?token *[=:] *[\"']?[0-9A-Za-z/+=]{100,}", "Critical"),
    ("azure-storage-key", "AccountKey=[0-9A-Za-z/+]{86}==", "Critical"),
    ("azure-client-secret", "\\b[0-9A-Za-z_~.]{3}8Q~[0-9A-Za-z_~.-]{34}", "Critical"),
    ("azure-sas", "[?&]sig=[0-9A-Za-z%]{43,53}%3[dD]", "High"),
    ("gcp-service-account", "\"type\" *: *\"service_account\"", "Critical"),
    ("gcp-oauth-token", "\\bya29\\.[0-9A-Za-z_-]{20,}", "Critical"),
    ("google-oauth-client", "\\b[0-9]{6,}-[0-9a-z]{32}\\.apps\\.googleusercontent\\.com", "Medium"),
    ("google-oauth-secret", "\\bGOCSPX-[0-9A-Za-z_-]{28}", "High"),
    ("oauth-bearer", "(?i)\\bauthorization *: *bearer +[0-9A-Za-z._~+/-]{16,}", "High"),
    ("basic-auth", "(?i)\\bauthorization *: *basic +[0-9A-Za-z+/]{8,}={0,2}", "High"),
    ("twilio-key", "\\bSK[0-9a-f]{32}\\b", "Critical"),
    ("twilio-account", "\\bAC[0-9a-f]{32}\\b", "Medium"),
    ("sendgrid-key", "\\bSG\\.[0-9A-Za-z_-]{22}\\.[0-9A-Za-z_-]{43}", "Critical"),
    ("mailgun-key", "\\bkey-[0-9a-f]{32}\\b", "High"),
    ("mailchimp-key", "\\b[0-9a-f]{32}-us[0-9]{1,2}\\b", "High"),
    ("slack-webhook", "https://hooks\\.slack\\.com/services/T[0-9A-Z]{6,}/B[0-9A-Z]{6,}/[0-9A-Za-z]{20,}", "High"),
    ("discord-webhook", "https://discord(?:app)?\\.com/api/webhooks/[0-9]{16,}/[0-9A-Za-z_-]{60,}", "High"),
    ("telegram-token", "\\b[0-9]{8,10}:AA[0-9A-Za-z_-]{33}", "High"),
    ("github-fine-token", "\\bgithub_pat_[0-9A-Za-z_]{60,}", "Critical"),
    ("gitlab-runner-token", "\\bGR1348941[0-9A-Za-z_-]{20}", "High"),
    ("bitbucket-token", "\\bATBB[0-9A-Za-z]{28,}", "High"),
    ("pypi-token", "\\bpypi-AgE[0-9A-Za-z_-]{50,}", "Critical"),
    ("rubygems-key", "\\brubygems_[0-9a-f]{48}\\b", "High"),
    ("docker-token", "\\bdckr_pat_[0-9A-Za-z_-]{27,}", "High"),
    ("digitalocean-token", "\\bdo[op]_v1_[0-9a-f]{64}\\b", "Critical"),
    ("heroku-key", "(?i)heroku[0-9a-z_ .-]{0,20}[=:] *[\"']?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "High"),
    ("shopify-token", "\\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}\\b", "Critical"),
    ("square-token", "\\bsq0(?:atp|csp)-[0-9A-Za-z_-]{22,}", "Critical"),
    ("stripe-webhook", "\\bwhsec_[0-9A-Za-z]{32,}", "High"),
    ("pgp-private-key", "-----BEGIN PGP PRIVATE KEY BLOCK-----", "Critical"),
    ("encrypted-private-key", "-----BEGIN ENCRYPTED PRIVATE KEY-----", "High"),
    ("jdbc-password", "(?i)jdbc:[a-z]+://[^\\s\"']+[?&;]password=[^\\s&;\"']+", "High"),
    ("generic-password", "(?i)\\b(?:passwd|pwd) *[=:] *[\"'][^\"'\\s]{8,64}[\"']", "Medium"),
    ("email", "[0-9A-Za-z._%+-]+@[0-9A-Za-z.-]+\\.[A-Za-z]{2,}", "Info"),
    ("ipv4", "\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b", "Info"),
)
#: Literals of which a text must hold one, in lower case, to have any match of the rule.  A search for a literal is a
#: small part of the price of a regular expression, and most texts hold none.
HINTS = {
    "aws-access-key": ("akia", "asia"), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gitlab-token": ("glpat-",), "slack-token": ("xox",), "jwt": ("eyj",), "private-key": ("private key-----",), "database-url": ("://",), "stripe-key": ("k_live_", "k_test_"), "google-api-key": ("aiza",), "npm-token": ("npm_",), "generic-token": ("token", "secret", "password", "api_key"),
    "aws-secret-key": ("aws",), "aws-session-token": ("aws",), "azure-storage-key": ("accountkey=",), "azure-client-secret": ("8q~",), "azure-sas": ("sig=",), "gcp-service-account": ("service_account",), "gcp-oauth-token": ("ya29.",), "google-oauth-client": ("googleusercontent",), "google-oauth-secret": ("gocspx-",), "oauth-bearer": ("bearer",), "basic-auth": ("authorization",), "sendgrid-key": ("sg.",), "mailgun-key": ("key-",), "mailchimp-key": ("-us",), "slack-webhook": ("hooks.slack",), "discord-webhook": ("/api/webhooks/",), "telegram-token": (":aa",), "github-fine-token": ("github_pat_",), "gitlab-runner-token": ("gr1348941",), "bitbucket-token": ("atbb",), "pypi-token": ("pypi-age",), "rubygems-key": ("rubygems_",), "docker-token": ("dckr_pat_",), "digitalocean-token": ("_v1_",), "heroku-key": ("heroku",), "shopify-token": ("shp",), "square-token": ("sq0",), "stripe-webhook": ("whsec_",), "pgp-private-key": ("pgp private",), "encrypted-private-key": ("encrypted private",), "jdbc-password": ("jdbc:",), "generic-password": ("passwd", "pwd"), "email": ("@",), "ipv4": (".",), "twilio-key": ("sk",), "twilio-account": ("ac",),
}
#: Rules whose provider could be asked whether the secret is live; no network is used, so such a match is Unverified.
VERIFIABLE = ("aws-access-key", "github-token", "github-fine-token", "gitlab-token", "slack-token", "stripe-key", "google-api-key", "npm-token", "sendgrid-key", "twilio-key", "digitalocean-token", "shopify-token", "pypi-token")
PLACEHOLDERS = "(?i)(example|placeholder|changeme|dummy|your[_-])"
TEST_PATHS = "(^|/)(tests?|__tests__|fixtures|testdata)/|(_test|\\.test|\\.spec)\\.[a-z]+$"


def det_regex(texts: DataFrame, key: str, text: str, rules: tuple[tuple[str, str, str], ...] = SECRET_RULES) -> DataFrame:
    """(key, rule_id, severity, match): every match of every rule; a rule with hints looks only at texts that hold one."""
    none = F.lit(None).cast("array<struct<rule_id:string,severity:string,match:string>>")

    def found(rule: str, pattern: str, severity: str) -> Column:
        hits = F.transform(F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), m.alias("match")))
        if rule not in HINTS:
            return hits
        seen = F.lit(False)
        for hint in HINTS[rule]:
            seen = seen | F.contains("__low", F.lit(hint))
        return F.when(seen, hits).otherwise(none)

    # An array of one element, so that lower case is made once and not for each rule.
    both = texts.select(F.col(key), F.explode(F.array(F.struct(F.col(text).alias("t"), F.lower(text).alias("l")))).alias("b")).select(key, F.col("b.t").alias("__text"), F.col("b.l").alias("__low"))
    hits = F.flatten(F.array_compact(F.array(*[found(*r) for r in rules])))
    return both.select(key, F.explode(hits).alias("h")).select(key, "h.*")


def det_verify(hits: DataFrame) -> DataFrame:
    """``hits`` (rule_id, ...) with verification_state: Unverified where a provider could be asked, else NotSupported."""
    return hits.withColumn("verification_state", F.when(F.col("rule_id").isin(*VERIFIABLE), "Unverified").otherwise("NotSupported"))


def det_entropy(texts: DataFrame, key: str, text: str, hex_least: float = 3.0, base64_least: float = 4.5) -> DataFrame:
    """(key, token, kind, entropy) of long hex and base64 tokens with at least the entropy of their kind."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9A-Za-z+/=_-]{20,}"), F.lit(0)))
    t = texts.select(key, F.explode(tokens).alias("token"))
    is_hex = F.col("token").rlike("^[0-9a-fA-F]+$")
    scored = t.withColumn("kind", F.when(is_hex, "hex").otherwise("base64")).withColumn("entropy", F.round(scalar.entropy(F.col("token")), 6))
    return scored.where(F.col("entropy") >= F.when(F.col("kind") == "hex", hex_least).otherwise(base64_least))


def det_context(hits: DataFrame, match: str, path: str | None = None) -> DataFrame:
    """Hits that are no placeholders and lie in no test file."""
    kept = hits.where(~F.col(match).rlike(PLACEHOLDERS))
    return kept if path is None else kept.where(~F.col(path).rlike(TEST_PATHS))


def min_severity(findings: DataFrame, least: str = "Info") -> DataFrame:
    return findings.where(scalar.sev_rank(F.col("severity")) <= scalar.sev_rank(F.lit(least)))


def min_confidence(findings: DataFrame, least: str = "Low") -> DataFrame:
    return findings.where(scalar.conf_rank(F.col("confidence")) <= scalar.conf_rank(F.lit(least)))


def glob_exclude(files: DataFrame, patterns: tuple[str, ...], path: str = "path") -> DataFrame:
    """Rows whose path no glob matches; the globs become one alternation."""
    return files.where(~F.col(path).rlike("|".join(map(scalar.glob_regex, patterns)))) if patterns else files


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def baseline_diff(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Findings that the baseline doesn't have."""
    return findings.join(baseline, key, "left_anti")


def changed_only(files: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """Files that are new or whose content hash differs from the known one."""
    return files.withColumn("hash", F.sha2(content, 256)).join(known, [key, "hash"], "left_anti")


def exempt(findings: DataFrame, exemptions: DataFrame, on: Column, key: str = "id") -> DataFrame:
    """Findings without an exemption that still holds on the day ``on``."""
    live = exemptions.where(on <= F.col("expires"))
    return findings.join(live, key, "left_anti")


def policy_filter(findings: DataFrame, severities: tuple[str, ...], project_glob: str, project: str = "project") -> DataFrame:
    return findings.where(F.col("severity").isin(*severities) & F.col(project).rlike(scalar.glob_regex(project_glob)))


def dyn_depth(projects: DataFrame, max_files: int = 500, max_bytes: int = 50 << 20) -> DataFrame:
    """One level less deep for large projects; deep becomes standard, standard becomes quick (our choice of levels)."""
    large = (F.col("files") > max_files) | (F.col("bytes") > max_bytes)
    down = F.when(F.col("depth") == "deep", "standard").when(F.col("depth") == "standard", "quick").otherwise(F.col("depth"))
    return projects.withColumn("depth", F.when(large, down).otherwise(F.col("depth")))


def join_advisory(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (ecosystem, package, version) with the advisories whose range [introduced, fixed) holds them.

    Equi-join on ecosystem and package with the range as a residual predicate; no fix means no upper end.
    """
    d = deps.withColumn("vk", scalar.version_key(F.col("version")))
    a = advisories.withColumn("lo", scalar.version_key(F.col("introduced"))).withColumn("hi", scalar.version_key(F.col("fixed")))
    return d.join(a, ["ecosystem", "package"]).where((F.col("vk") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("vk") < F.col("hi")))).drop("vk", "lo", "hi")


def semver_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Intersections of the half-open version ranges (lo, hi) of two tables with equal key; empty ones go."""
    k = scalar.version_key
    j = a.select(key, F.col("lo").alias("alo"), F.col("hi").alias("ahi")).join(b.select(key, F.col("lo").alias("blo"), F.col("hi").alias("bhi")), key)
    lo = F.when(k(F.col("alo")) >= k(F.col("blo")), F.col("alo")).otherwise(F.col("blo"))
    hi = F.when(F.col("ahi").isNull(), F.col("bhi")).when(F.col("bhi").isNull(), F.col("ahi")).when(k(F.col("ahi")) <= k(F.col("bhi")), F.col("ahi")).otherwise(F.col("bhi"))
    return j.select(key, lo.alias("lo"), hi.alias("hi")).where(F.col("hi").isNull() | (k(F.col("lo")) < k(F.col("hi"))))


def safe_version(deps: DataFrame, versions: DataFrame, prereleases: bool = False, queries: int = 50) -> DataFrame:
    """(ecosystem, package, version, nearest_safe, latest_safe, next_minor, impact) from ``versions`` (…, candidate, safe).

    Packages are deduplicated first; the newest ``queries`` candidates of each are considered.
    """
    key = ["ecosystem", "package", "version"]
    newest = Window.partitionBy("ecosystem", "package").orderBy(F.desc("ck"))
    c = versions.withColumn("ck", scalar.version_key(F.col("candidate")))
    if not prereleases:
        c = c.where(~scalar.is_prerelease(F.col("candidate")))
    c = c.withColumn("nth", F.row_number().over(newest)).where(F.col("safe") & (F.col("nth") <= queries))
    vk = F.col("vk")
    j = deps.select(*key).distinct().withColumn("vk", scalar.version_key(F.col("version"))).join(c, ["ecosystem", "package"], "left")
    up = F.col("ck") >= vk
    minor = up & (F.get("ck", F.lit(0)) == F.get(vk, F.lit(0))) & (F.get("ck", F.lit(1)) > F.get(vk, F.lit(1)))
    pick = lambda cond, f: f(F.when(cond, F.col("candidate")), F.when(cond, F.col("ck")))
    g = j.groupBy(*key).agg(pick(up, F.min_by).alias("nearest_safe"), pick(F.lit(True), F.max_by).alias("latest_safe"), pick(minor, F.min_by).alias("next_minor"))
    return g.withColumn("impact", scalar.version_impact(F.col("version"), F.col("nearest_safe")))


def union_advisories(*sources: DataFrame) -> DataFrame:
    """One row an advisory id: the sources that have it, sorted, and the highest severity."""
    all_ = sources[0]
    for s in sources[1:]:
        all_ = all_.unionByName(s)
    return all_.groupBy("advisory").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min(scalar.sev_rank(F.col("severity"))).alias("rank"))
