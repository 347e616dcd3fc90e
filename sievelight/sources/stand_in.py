"""The driver's tables read as the entities of the findings model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat findings; ``ord`` numbers the findings of a job in module and then finding order."""
    li = table(spark, sf_dir, "lineitem")
    module = F.col("l_suppkey") % 4
    part = F.col("l_partkey")
    raw = li.select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        module.cast("int").alias("module_ord"),
        F.element_at(F.array(*[F.lit(m) for m in ("DependencyAnalyzer", "SAST", "SecretDetection", "ApiSecurity")]), (module + 1).cast("int")).alias("module_type"),
        F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_quantity") >= 46, "Critical").when(F.col("l_quantity") >= 36, "High").when(F.col("l_quantity") >= 21, "Medium").when(F.col("l_quantity") >= 6, "Low").otherwise("Info").alias("severity"),
        F.when(F.col("l_discount") >= 0.07, "High").when(F.col("l_discount") >= 0.03, "Medium").otherwise("Low").alias("confidence"),
        F.concat(F.lit("src/f"), part % 200, F.lit(".py")).alias("path"),
        F.concat(F.element_at(F.array(F.lit("npm"), F.lit("pypi"), F.lit("cargo")), (F.col("l_suppkey") % 3 + 1).cast("int")), F.lit(":pkg"), part % 50, F.lit("@"), part % 7, F.lit("."), F.col("l_linenumber"), F.lit(".0")).alias("dep_path"),
        F.element_at(F.array(F.lit('{"nearest_safe":"1.2.3","latest_safe":"2.0.0"}'), F.lit("1.2"), F.lit("upgrade now"), F.lit('{"nearest_safe":5,"latest_safe":"3.1.0"}'), F.lit("{}"), F.lit(None)), (part % 6 + 1).cast("int")).alias("recommendation"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.when(F.col("l_tax") >= 0.01, F.concat(F.lit("rule-"), F.floor(F.col("l_tax") * 100 + 0.5).cast("int"))).alias("rule_id"),
        (F.col("l_returnflag") != "R").alias("ok"),
        F.col("l_shipdate").alias("ts"),
        *ORDER,
    )
    order = Window.partitionBy("job_id").orderBy("module_ord", *ORDER, "id")
    return raw.withColumn("ord", F.row_number().over(order)).drop(*ORDER)


#: The same in DuckDB, as a common table expression.
FINDINGS_SQL = """findings AS (SELECT job_id, module_ord, module_type, id, severity, confidence, path, dep_path, recommendation, line, rule_id, ok, ts,
 row_number() OVER (PARTITION BY job_id ORDER BY module_ord, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, id) AS ord FROM
 (SELECT *, CAST(l_orderkey AS VARCHAR) AS job_id, CAST(l_suppkey % 4 AS INTEGER) AS module_ord,
 CASE l_suppkey % 4 WHEN 0 THEN 'DependencyAnalyzer' WHEN 1 THEN 'SAST' WHEN 2 THEN 'SecretDetection' ELSE 'ApiSecurity' END AS module_type,
 l_orderkey || '-' || l_linenumber AS id,
 CASE WHEN l_quantity >= 46 THEN 'Critical' WHEN l_quantity >= 36 THEN 'High' WHEN l_quantity >= 21 THEN 'Medium' WHEN l_quantity >= 6 THEN 'Low' ELSE 'Info' END AS severity,
 CASE WHEN l_discount >= 0.07 THEN 'High' WHEN l_discount >= 0.03 THEN 'Medium' ELSE 'Low' END AS confidence,
 'src/f' || (l_partkey % 200) || '.py' AS path,
 (['npm', 'pypi', 'cargo'])[l_suppkey % 3 + 1] || ':pkg' || (l_partkey % 50) || '@' || (l_partkey % 7) || '.' || l_linenumber || '.0' AS dep_path,
 (['{"nearest_safe":"1.2.3","latest_safe":"2.0.0"}', '1.2', 'upgrade now', '{"nearest_safe":5,"latest_safe":"3.1.0"}', '{}', NULL])[l_partkey % 6 + 1] AS recommendation,
 CAST(l_linenumber AS BIGINT) AS line,
 CASE WHEN l_tax >= 0.01 THEN 'rule-' || CAST(floor(l_tax * 100 + 0.5) AS INTEGER) END AS rule_id,
 l_returnflag <> 'R' AS ok, l_shipdate AS ts FROM lineitem))"""


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as a tree: a region is the parent of its nations; every sixth nation hangs below another."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    parent = F.when(F.col("n_nationkey") % 6 == 5, F.concat(F.lit("n"), F.col("n_nationkey") - 1)).otherwise(F.concat(F.lit("r"), F.col("n_regionkey")))
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), parent.alias("parent_id")).unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id")))


def subscription_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an organization but for region 3 and every eleventh nation."""
    orgs = organizations(spark, sf_dir)
    k = F.substring("id", 2, 9).cast("int")
    region = F.col("id").startswith("r")
    return orgs.where(~((F.col("id") == "r3") | (~region & (k % 11 == 10)))).select(
        F.col("id").alias("organization_id"),
        F.when(region, "enterprise").when(k % 2 == 0, "pro").otherwise("free").alias("tier"),
        F.when(region, 1000).otherwise(10 + k).alias("max_scans_monthly"),
        F.when(region, 100000).otherwise(500 + k).alias("max_api_calls_monthly"),
        (~region & (k % 3 != 0)).alias("inherit_limits"),
    )


ORGS_SQL = """organizations AS (SELECT 'n' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 6 = 5 THEN 'n' || (n_nationkey - 1) ELSE 'r' || n_regionkey END AS parent_id FROM nation
 UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region),
subscription_limits AS (SELECT id AS organization_id, CASE WHEN id LIKE 'r%' THEN 'enterprise' WHEN CAST(id[2:] AS INTEGER) % 2 = 0 THEN 'pro' ELSE 'free' END AS tier,
 CASE WHEN id LIKE 'r%' THEN 1000 ELSE 10 + CAST(id[2:] AS INTEGER) END AS max_scans_monthly, CASE WHEN id LIKE 'r%' THEN 100000 ELSE 500 + CAST(id[2:] AS INTEGER) END AS max_api_calls_monthly,
 id NOT LIKE 'r%' AND CAST(id[2:] AS INTEGER) % 3 <> 0 AS inherit_limits FROM organizations WHERE NOT (id = 'r3' OR (id LIKE 'n%' AND CAST(id[2:] AS INTEGER) % 11 = 10)))"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested status changes of the job o_orderkey: seq, to_status and ts, some of them invalid."""
    o = table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Completed").otherwise("Cancelled")
    steps = F.array(*[F.struct(F.lit(k).alias("seq"), s.alias("to_status")) for k, s in enumerate((F.lit("Queued"), F.lit("Running"), end, F.lit("Running")), 1)])
    wide = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.explode(steps).alias("s"))
    return wide.select("job_id", F.col("s.seq").alias("seq"), F.col("s.to_status").alias("to_status"), (F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("s.seq") * ((F.col("job_id") % 50).cast("int") + 1))).alias("ts"))


TRANSITIONS_SQL = """requests AS (SELECT o_orderkey AS job_id, s.seq AS seq, s.to_status AS to_status, CAST(o_orderdate AS TIMESTAMP) + to_minutes(s.seq * (o_orderkey % 50 + 1)) AS ts FROM
 (SELECT *, unnest([{'seq': 1, 'to_status': 'Queued'}, {'seq': 2, 'to_status': 'Running'}, {'seq': 3, 'to_status': CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Completed' ELSE 'Cancelled' END}, {'seq': 4, 'to_status': 'Running'}]) AS s FROM orders))"""
