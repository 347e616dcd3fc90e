"""Analysis modules as functions between DataFrames, and their runner.

A module has a type, a default configuration and ``execute(inputs, config)``, which gives findings in one schema.
The runner joins the results of the modules that a job asks for; no module knows of the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import api, detect

Inputs = Mapping[str, DataFrame]
FINDING = ("module_type", "source", "rule_id", "severity", "confidence", "path", "description")


def finding(df: DataFrame, module: str, source: Column, rule: Column, severity: Column, confidence: str = "Medium", path: Column | None = None, description: Column | None = None) -> DataFrame:
    """Rows in the schema of findings; all columns are strings."""
    none = F.lit(None).cast("string")
    cells = (F.lit(module), source, rule, severity, F.lit(confidence), none if path is None else path, none if description is None else description)
    return df.select(*[c.cast("string").alias(n) for c, n in zip(cells, FINDING, strict=True)])


@dataclass(frozen=True)
class Module:
    """``needs`` names the inputs that it reads; without all of them it is skipped."""

    module_type: str
    needs: tuple[str, ...]
    execute: Callable[[Inputs, Mapping], DataFrame]
    defaults: Mapping = field(default_factory=dict)

    def prepare(self, config: Mapping | None = None) -> dict:
        """The defaults with the keys of ``config`` that the module knows put over them."""
        return {k: (config or {}).get(k, v) for k, v in self.defaults.items()}


def _secrets(inputs: Inputs, config: Mapping) -> DataFrame:
    hits = detect.min_severity(detect.det_regex(inputs["texts"], "key", "text"), config["min_severity"])
    return finding(hits, "SecretDetection", F.col("key"), F.col("rule_id"), F.col("severity"), "High", description=F.concat(F.substring("match", 1, 4), F.lit("****")))


def _sast(inputs: Inputs, config: Mapping) -> DataFrame:
    hits = detect.det_regex(inputs["texts"], "key", "text", config["rules"])
    return finding(hits, "SAST", F.col("key"), F.col("rule_id"), F.col("severity"))


def _api(inputs: Inputs, config: Mapping) -> DataFrame:
    hits = api.det_api(inputs["specs"], "key", "spec", config["enabled_analyzers"], config["severity_overrides"], config["exclude_paths"])
    return finding(hits, "ApiSecurity", F.col("key"), F.col("rule_id"), F.col("severity"), path=F.concat_ws(" ", F.upper("method"), "path"), description=F.col("analyzer"))


def _dependencies(inputs: Inputs, config: Mapping) -> DataFrame:
    hits = detect.join_advisory(inputs["dependencies"], inputs["advisories"])
    return finding(hits, "DependencyAnalyzer", F.concat_ws(":", "ecosystem", "package"), F.col("advisory"), F.lit(config["severity"]), "High", description=F.col("version"))


REGISTRY = {
    m.module_type: m
    for m in (
        Module("DependencyAnalyzer", ("dependencies", "advisories"), _dependencies, {"severity": "High"}),
        Module("SAST", ("texts",), _sast, {"rules": (("eval-call", "\\beval *\\(", "High"), ("shell-call", "\\b(?:os\\.system|subprocess\\.call) *\\(", "High"), ("weak-hash", "\\b(?:md5|sha1) *\\(", "Medium"))}),
        Module("SecretDetection", ("texts",), _secrets, {"min_severity": "Low"}),
        Module("ApiSecurity", ("specs",), _api, {"enabled_analyzers": (), "severity_overrides": {}, "exclude_paths": ()}),
    )
}


def run_modules(inputs: Inputs, wanted: tuple[str, ...] = schema.COMMUNITY, configs: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Findings of the ``wanted`` modules that are registered and whose inputs are there, in one table."""
    live = [REGISTRY[m] for m in wanted if m in REGISTRY and all(n in inputs for n in REGISTRY[m].needs)]
    if not live:
        raise ValueError("no module of those has its inputs")
    return reduce(DataFrame.unionByName, [m.execute(inputs, m.prepare((configs or {}).get(m.module_type))) for m in live])
