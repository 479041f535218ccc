"""Workload definitions as JSON text, one per part, and the same facts as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concord.operators.validate import parse_definitions
from concord.plans.registry import table

API_VERSION = "CASE WHEN p_size < 10 THEN 'runtime/v1alpha1' WHEN p_size = 50 THEN 'runtime/v2' ELSE 'runtime/v1' END"
SPARK = "CASE WHEN p_size < 15 THEN '4.0' WHEN p_size < 30 THEN '4.1' WHEN p_size < 45 THEN '4.2' ELSE '3.5' END"
TYPE = (
    "CASE p_type WHEN 'PROMO' THEN 'jvm-jar' WHEN 'LARGE' THEN 'spark-declarative-pipeline' "
    "WHEN 'MEDIUM' THEN 'sql' ELSE 'python-wheel' END"
)
ARTIFACT = "CASE WHEN p_type <> 'LARGE' THEN concat('artifact://', p_brand, '/', p_type) END"
ENTRY_POINT = "CASE WHEN p_type NOT IN ('LARGE', 'SMALL') THEN 'jobs.main' END"
PIPELINE = "CASE WHEN p_type = 'LARGE' AND p_size > 5 THEN 'artifact://pipe/1' END"
CORES = "CASE WHEN p_size <> 7 THEN 2 END"
GPU, STREAMING, DYNAMIC = "p_size > 40", "p_size BETWEEN 20 AND 25", "p_size < 5"
OVERRIDES = {"Brand#1": "kubernetes", "Brand#2": "databricks"}


def documents(parts: DataFrame) -> DataFrame:
    """``name, version, environment_name, definition`` (JSON), plus the part's columns."""
    refs = lambda **named: F.struct(*[F.struct(c.alias("dataset")).alias(n) for n, c in named.items()])
    size = lambda cores: F.struct(F.expr(cores).alias("cores"), F.lit("2Gi").alias("memory"))
    # an empty namespace for Brand#2: it must not count as an override
    overrides = F.when(
        F.col("p_brand") == "Brand#1", F.from_json(F.lit('{"kubernetes":{"node":"big"}}'), "map<string,map<string,string>>")
    ).when(F.col("p_brand") == "Brand#2", F.from_json(F.lit('{"databricks":{}}'), "map<string,map<string,string>>"))
    document = F.struct(
        F.expr(API_VERSION).alias("apiVersion"),
        F.lit("SparkWorkload").alias("kind"),
        F.struct(F.concat(F.lit("w"), "p_partkey").alias("name"), F.col("p_size").cast("string").alias("version")).alias("metadata"),
        F.struct(F.expr(SPARK).alias("spark")).alias("runtime"),
        F.struct(
            F.expr(TYPE).alias("type"),
            F.expr(ARTIFACT).alias("artifact"),
            F.expr(ENTRY_POINT).alias("entryPoint"),
            F.expr(PIPELINE).alias("pipelineSpec"),
        ).alias("application"),
        F.struct(
            refs(src=F.col("p_type")).alias("inputs"), refs(out=F.col("p_name"), again=F.col("p_brand")).alias("outputs")
        ).alias("datasets"),
        F.struct(
            size("1").alias("driver"),
            size(CORES).alias("executor"),
            F.struct(F.lit(1).alias("minExecutors"), F.lit(4).alias("maxExecutors")).alias("scaling"),
        ).alias("resources"),
        F.struct(F.lit("1h").alias("timeout")).alias("execution"),
        F.struct(
            F.expr(GPU).alias("gpu"), F.expr(STREAMING).alias("streaming"), F.expr(DYNAMIC).alias("dynamicAllocation")
        ).alias("requirements"),
        overrides.alias("providerOverrides"),
    )
    return parts.select(
        F.concat(F.lit("w"), "p_partkey").alias("name"),
        F.col("p_size").cast("string").alias("version"),
        F.col("p_brand").alias("environment_name"),
        F.to_json(document).alias("definition"),
    )


def parsed(spark, d) -> DataFrame:
    return parse_definitions(documents(table(spark, d, "part")))


# The same facts for SQL: one row per definition.
FACTS = f"""(SELECT 'w' || p_partkey AS name, CAST(p_size AS VARCHAR) AS version, p_brand AS environment_name,
    {API_VERSION} AS api_version, {SPARK} AS spark, {TYPE} AS type, {ARTIFACT} AS artifact,
    {ENTRY_POINT} AS entry_point, {PIPELINE} AS pipeline, {CORES} AS cores, {GPU} AS gpu, {STREAMING} AS streaming,
    {DYNAMIC} AS dynamic, p_brand = 'Brand#1' AS overridden, p_type, p_name, p_brand FROM part)"""

# Dataset bindings derived from the parts: two thirds of the (type, brand) pairs, half of the (name, brand) pairs.
BINDINGS = """SELECT p_type AS dataset_name, p_brand AS environment_name,
        CASE WHEN p_type = 'PROMO' THEN 'table' ELSE 'path' END AS kind,
        CASE WHEN p_type = 'PROMO' THEN concat('sales.', lower(p_type)) ELSE concat('s3a://raw/', p_type) END AS uri
    FROM part WHERE p_size < 3 AND p_type <> 'ECONOMY' GROUP BY 1, 2
    UNION ALL SELECT p_name, p_brand, 'path', concat('s3a://out/', p_name) FROM part WHERE p_size > 25 GROUP BY 1, 2"""


def bindings(spark, d) -> DataFrame:
    return spark.sql(BINDINGS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
