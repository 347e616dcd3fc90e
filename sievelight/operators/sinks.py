"""Reports and exports."""

from __future__ import annotations

import gzip
import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

MARKER = b"GZP_"


def sarif_result() -> Column:
    """One SARIF result as a struct; absent members stay null and are left out of the JSON."""
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(F.struct(F.col("description").alias("text")).alias("message"), scalar.sarif_level(F.col("severity")).alias("level"), F.col("rule_id").alias("ruleId"), F.array(place).alias("locations"))


def sink_sarif(findings: DataFrame, tool: str = "sievelight", version: str = "0.1.0") -> DataFrame:
    """(job_id, sarif): one SARIF 2.1.0 document a job, with all findings of all results in order, not deduplicated."""
    g = findings.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.to_json(sarif_result()).alias("r")))).alias("rs"), F.count("*").alias("n"))
    driver = F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version")))
    doc = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":'), driver, F.lit('},"results":['), F.array_join(F.transform("rs", lambda x: x["r"]), ","), F.lit('],"properties":'), F.to_json(F.struct("job_id", F.col("n").alias("total_findings"))), F.lit("}]}"))
    return g.select("job_id", doc.alias("sarif"))


def sink_report(results: DataFrame) -> DataFrame:
    """Module status rows of the job report; missing counts are 0."""
    return results.select("job_id", "module_type", scalar.status_of(F.col("error")).alias("status"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def sink_metrics(values: DataFrame) -> DataFrame:
    """Rows (name, value) as Prometheus text lines."""
    return values.select(F.format_string("%s %d", "name", F.col("value").cast("long")).alias("line"))


def codec_gzip(threshold: int = 10_240) -> Callable[[pd.Series], pd.Series]:
    """Compressing function for payloads: gzip behind a marker from ``threshold`` bytes on, otherwise as they are."""
    return lambda data: data.map(lambda b: b if b is None or len(b) < threshold else MARKER + gzip.compress(b, mtime=0))


def decode_gzip(data: pd.Series) -> pd.Series:
    return data.map(lambda b: gzip.decompress(b[len(MARKER) :]) if b is not None and b[: len(MARKER)] == MARKER else b)


def sign(payloads: DataFrame, secret: str) -> DataFrame:
    """``payloads`` (ts, body) with ``signature``, the hex HMAC-SHA256 of ts + '.' + body.

    HMAC from built-in hashes: H(key ^ opad, H(key ^ ipad, message)), so no Python runs per row.
    """
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)
    message = F.concat(F.lit(bytearray(inner)), F.encode(F.concat(F.col("ts"), F.lit("."), F.col("body")), "UTF-8"))
    return payloads.withColumn("signature", F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(message, 256))), 256))


def deliver(rows: Iterator, post: Callable[[str, str], bool], sleep: Callable[[float], None], attempts: int = 3) -> list[bool]:
    """Send (body, signature) rows with at most three attempts, 1 s and 2 s apart; a failure is only reported."""
    out = []
    for body, signature in rows:
        sent = False
        for k in range(attempts):
            sent = post(body, signature)
            if sent or k == attempts - 1:
                break
            sleep(float(1 << k))
        out.append(sent)
    return out


def reference_hmac(secret: str, ts: str, body: str) -> str:
    return hmac.new(secret.encode(), f"{ts}.{body}".encode(), hashlib.sha256).hexdigest()
