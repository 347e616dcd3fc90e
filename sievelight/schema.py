"""Schemas, ranks and small dimension tables of the findings model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_s, _l, _d, _b, _i, _t = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LOCATION = _struct(path=_s, line=_l, column=_l, end_line=_l, end_column=_l)
SECRET_METADATA = _struct(detector_id=_s, verification_state=_s, redacted_secret=_s, entropy=_d, evidence=T.ArrayType(_s))
PATH_NODE = _struct(location=LOCATION, description=_s, expression=_s)
SEMANTIC_PATH = _struct(source=PATH_NODE, steps=T.ArrayType(PATH_NODE), sink=PATH_NODE)
VULNERABILITY_METADATA = _struct(snippet=_s, bindings=T.MapType(_s, _s), semantic_path=SEMANTIC_PATH)
ENRICHMENT = _struct(explanation=_s, remediation_suggestion=_s, risk_summary=_s, enrichment_successful=_b, error=_s, enriched_at=_t)
FINDING = _struct(id=_s, type=_s, rule_id=_s, location=LOCATION, severity=_s, confidence=_s, description=_s, recommendation=_s, secret_metadata=SECRET_METADATA, vulnerability_metadata=VULNERABILITY_METADATA, enrichment=ENRICHMENT)
MODULE_RESULT = _struct(job_id=_s, module_type=_s, module_ord=_i, error=_s, files_scanned=_l, duration_ms=_l, additional_info=T.MapType(_s, _s), findings=T.ArrayType(FINDING))
FLAT_FINDING = _struct(job_id=_s, module_type=_s, module_ord=_i, finding_ord=_i, id=_s, type=_s, rule_id=_s, path=_s, line=_l, column=_l, end_line=_l, end_column=_l, severity=_s, confidence=_s, description=_s, recommendation=_s, module_error=_s)
TRANSITION = _struct(job_id=_s, seq=_i, from_status=_s, to_status=_s, ts=_t, reason=_s)

SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
CONFIDENCES = ("High", "Medium", "Low")
SEVERITY_SCORES = dict(zip(SEVERITIES, (100, 80, 50, 20, 5), strict=True))
CONFIDENCE_SCORES = dict(zip(CONFIDENCES, (15, 8, 3), strict=True))
COMMUNITY = ("DependencyAnalyzer", "SAST", "SecretDetection", "ApiSecurity")
ENTERPRISE = ("MaliciousPackageDetection", "LicenseCompliance", "SBOM", "DAST", "FuzzTesting", "IaC", "CSPM")
MODULES = COMMUNITY + ENTERPRISE
BUCKETS = {"SAST": "sast", "SecretDetection": "secrets", "DependencyAnalyzer": "dependencies", "ApiSecurity": "api"}
STATUSES = ("Pending", "Queued", "Running", "Completed", "Failed", "Cancelled")
JOB_EDGES = (("Pending", "Queued"), ("Pending", "Cancelled"), ("Queued", "Running"), ("Queued", "Cancelled"), ("Running", "Completed"), ("Running", "Failed"))
FINDING_EDGES = (("Open", "In Progress"), ("In Progress", "Resolved"), ("In Progress", "False Positive"), ("In Progress", "Acknowledged"))
TERMINAL = ("Completed", "Failed", "Cancelled")


def modules(spark: SparkSession) -> DataFrame:
    """(module_type, ord, tier): a fixed dimension of eleven rows."""
    rows = [(m, k, "community" if m in COMMUNITY else "enterprise") for k, m in enumerate(MODULES)]
    return spark.createDataFrame(rows, "module_type string, ord int, tier string")


def edges(spark: SparkSession, pairs: tuple[tuple[str, str], ...] = JOB_EDGES) -> DataFrame:
    return spark.createDataFrame(list(pairs), "from_status string, to_status string")
