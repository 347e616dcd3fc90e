"""Analyzers of OpenAPI specifications, as expressions over the parsed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECURITY = "array<map<string,array<string>>>"
_PARAMETER = "struct<name:string,`in`:string,schema:struct<type:string,maxLength:bigint,`enum`:array<string>>>"
_RESPONSE = "struct<headers:map<string,struct<example:string,schema:struct<example:string>>>>"
_OPERATION = f"struct<security:{_SECURITY},parameters:array<{_PARAMETER}>,requestBody:struct<content:map<string,struct<schema:struct<type:string,`$ref`:string>>>>,responses:map<string,{_RESPONSE}>>"
_FLOW = "struct<authorizationUrl:string,tokenUrl:string>"
SPEC = f"openapi string, info struct<version:string>, servers array<struct<url:string>>, security {_SECURITY}, components struct<securitySchemes:map<string,struct<type:string,scheme:string,`in`:string,flows:map<string,{_FLOW}>>>>, paths map<string,string>"

#: rule -> (analyzer, severity).  The nine analyzers are documented by name; which rules they have is our definition.
RULES = {
    "missing_authentication": ("authentication", "High"),
    "weak_scheme": ("authentication", "Medium"),
    "missing_scopes": ("authorization", "Medium"),
    "unbounded_parameter": ("input_validation", "Low"),
    "missing_request_schema": ("input_validation", "Medium"),
    "sensitive_parameter": ("data_exposure", "High"),
    "missing_security_headers": ("security_headers", "Medium"),
    "insecure_cors": ("security_headers", "High"),
    "implicit_flow": ("oauth", "Medium"),
    "insecure_token_url": ("oauth", "High"),
    "missing_version": ("design", "Low"),
    "missing_error_responses": ("design", "Low"),
    "insecure_server": ("misconfiguration", "Medium"),
    "missing_rate_limit": ("resource_restriction", "Low"),
}
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
HEADERS = ("content-security-policy", "strict-transport-security", "x-frame-options", "x-content-type-options")
SENSITIVE = "(?i)^(password|passwd|secret|token|access_token|api_?key|ssn)$"


def _none(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def _some(c: Column, test) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def det_api(specs: DataFrame, key: str, spec: str, enabled: tuple[str, ...] = (), overrides: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, method, analyzer, rule_id, severity): findings of the JSON specifications in column ``spec``.

    Rules look at the whole document (path and method null) or at one operation.  ``enabled`` names the analyzers to
    run (none: all), ``overrides`` maps a rule to another severity, and operations below the paths ``exclude`` are
    skipped.  A text that is no JSON object with ``openapi`` has no findings; only OpenAPI 3 documents are judged.
    """
    doc = specs.select(F.col(key), F.from_json(spec, SPEC).alias("s")).where(F.col("s.openapi").startswith("3."))
    schemes = F.map_values("s.components.securitySchemes")
    flows = lambda sc: F.map_values(sc["flows"])
    plain = lambda url: F.coalesce(url.startswith("http://"), F.lit(False))
    whole = {
        "weak_scheme": _some(schemes, lambda x: ((x["type"] == "http") & (F.lower(x["scheme"]) == "basic")) | ((x["type"] == "apiKey") & (x["in"] == "query"))),
        "implicit_flow": _some(schemes, lambda x: F.coalesce(F.map_contains_key(x["flows"], "implicit"), F.lit(False))),
        "insecure_token_url": _some(schemes, lambda x: F.coalesce(F.exists(flows(x), lambda f: plain(f["authorizationUrl"]) | plain(f["tokenUrl"])), F.lit(False))),
        "missing_version": F.col("s.info.version").isNull(),
        "insecure_server": _some(F.col("s.servers"), lambda x: plain(x["url"]) & ~x["url"].rlike("^http://(localhost|127\\.)")),
    }
    op, good = F.col("op"), F.filter(F.map_entries("op.responses"), lambda e: e["key"].startswith("2"))
    security = F.coalesce(op["security"], F.col("top"))
    headers = lambda e: F.transform(F.coalesce(F.map_keys(e["value"]["headers"]), F.array().cast("array<string>")), F.lower)
    each = {
        "missing_authentication": _none(security),
        "missing_scopes": _some(security, lambda m: F.exists(F.map_entries(m), lambda e: F.array_contains(F.col("oauth"), e["key"]) & (F.size(e["value"]) == 0))),
        "unbounded_parameter": _some(op["parameters"], lambda p: (p["schema"]["type"] == "string") & p["schema"]["maxLength"].isNull() & p["schema"]["enum"].isNull()),
        "missing_request_schema": _some(F.map_values(op["requestBody"]["content"]), lambda c: c["schema"].isNull()),
        "sensitive_parameter": _some(op["parameters"], lambda p: p["in"].isin("query", "path") & p["name"].rlike(SENSITIVE)),
        "missing_security_headers": _some(good, lambda e: F.size(F.array_except(F.array(*map(F.lit, HEADERS)), headers(e))) > 0),
        "insecure_cors": _some(F.map_values(op["responses"]), lambda r: F.coalesce(F.exists(F.map_entries(r["headers"]), lambda h: (F.lower(h["key"]) == "access-control-allow-origin") & (F.coalesce(h["value"]["example"], h["value"]["schema"]["example"]) == "*")), F.lit(False))),
        "missing_error_responses": ~_some(F.map_keys(op["responses"]), lambda k: k.rlike("^[45]|^default$")),
        "missing_rate_limit": ~_some(F.map_keys(op["responses"]), lambda k: k == "429"),
    }

    def found(tests: dict[str, Column]) -> Column:
        rows = []
        for rule, test in tests.items():
            analyzer, severity = RULES[rule]
            if not enabled or analyzer in enabled:
                row = F.struct(F.lit(analyzer).alias("analyzer"), F.lit(rule).alias("rule_id"), F.lit((overrides or {}).get(rule, severity)).alias("severity"))
                rows.append(F.when(F.coalesce(test, F.lit(False)), row))
        return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<analyzer:string,rule_id:string,severity:string>>")

    oauth = F.map_keys(F.map_filter("s.components.securitySchemes", lambda _, x: x["type"].isin("oauth2", "openIdConnect")))
    paths = doc.select(key, F.col("s.security").alias("top"), F.coalesce(oauth, F.array().cast("array<string>")).alias("oauth"), F.explode("s.paths").alias("path", "item"))
    # A path's item also holds members that are no operations, of other types, so each operation is parsed by itself.
    for p in exclude:
        paths = paths.where(~((F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")))
    members = paths.select(key, "path", "top", "oauth", F.explode(F.from_json("item", "map<string,string>")).alias("method", "raw")).where(F.col("method").isin(*METHODS))
    operations = members.withColumn("op", F.from_json("raw", _OPERATION))
    none = F.lit(None).cast("string")
    out = doc.select(key, none.alias("path"), none.alias("method"), F.explode(found(whole)).alias("f")).unionByName(operations.select(key, "path", "method", F.explode(found(each)).alias("f")))
    return out.select(key, "path", "method", "f.*")
