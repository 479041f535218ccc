"""Definition validation, capabilities, runtimes and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import definition as D
from concord.functions import state as ST
from concord.functions.text import joined_errors
from concord.operators import validate as V
from concord.plans import workloads as W
from concord.plans.registry import query, table
from concord.sources import datasets as S

# Capabilities of the two execution providers.
_CAPABILITIES = [
    ("kubernetes", ["4.1", "4.2"], ["python", "jvm"], True, False, False, True, False, "live_verified"),
    ("databricks", ["4.0", "4.1", "4.2"], ["python", "jvm"], False, False, False, True, False, "live_verified"),
]
_CAPABILITY_SCHEMA = (
    "provider string, spark_versions array<string>, languages array<string>, dynamic_allocation boolean, gpu boolean, "
    "streaming boolean, local_disk boolean, spark_connect boolean, verification string"
)
_TARGETS = ["kubernetes", "databricks"]


def capabilities(spark):
    return S.scan_rows(spark, _CAPABILITIES, _CAPABILITY_SCHEMA)


@query(
    f"""SELECT name, version, api_version, spark, type, CAST(cores AS BIGINT) AS executor_cores, CAST(0 AS BIGINT) AS retries,
    gpu, dynamic, false AS local_disk, p_name AS first_output, CAST(2 AS BIGINT) AS outputs FROM {W.FACTS}"""
)
def parse_definitions(spark, d):
    return W.parsed(spark, d).select(
        "name",
        "version",
        F.col("definition.apiVersion").alias("api_version"),
        F.col("definition.runtime.spark").alias("spark"),
        F.col("definition.application.type").alias("type"),
        F.col("definition.resources.executor.cores").cast("bigint").alias("executor_cores"),
        F.col("definition.execution.retries").cast("bigint").alias("retries"),
        F.col("definition.requirements.gpu").alias("gpu"),
        F.col("definition.requirements.dynamicAllocation").alias("dynamic"),
        F.col("definition.requirements.localDisk").alias("local_disk"),
        F.col("definition.outputs")[0]["dataset"].alias("first_output"),
        F.size("definition.outputs").cast("bigint").alias("outputs"),
    )


_ERRORS = """concat_ws('; ',
    CASE WHEN api_version = 'runtime/v2' THEN 'apiVersion must be runtime/v1 or runtime/v1alpha1: runtime/v2' END,
    CASE WHEN type = 'sql' THEN 'application.type must be python-wheel or jvm-jar or spark-declarative-pipeline: sql' END,
    CASE WHEN type = 'spark-declarative-pipeline' AND pipeline IS NULL
        THEN 'pipelineSpec is required when type is ''spark-declarative-pipeline''' END,
    CASE WHEN type IN ('python-wheel', 'jvm-jar') AND (artifact IS NULL OR entry_point IS NULL)
        THEN 'artifact and entryPoint are required when type is ''' || type || '''' END,
    CASE WHEN cores IS NULL THEN 'missing resources.executor.cores' END)"""


@query(f"SELECT name, {_ERRORS} AS errors, api_version = 'runtime/v1alpha1' AS deprecated FROM {W.FACTS}")
def validate_definition(spark, d):
    return V.validate_definitions(W.parsed(spark, d)).select("name", joined_errors(F.col("errors")).alias("errors"), "deprecated")


@query(
    f"""WITH v AS (SELECT p_type, api_version, {_ERRORS} = '' AS valid FROM {W.FACTS})
    SELECT p_type, count(*) FILTER (WHERE valid) AS valid_before,
    count(*) FILTER (WHERE valid AND api_version = 'runtime/v1') AS still_valid FROM v GROUP BY 1"""
)
def upgrade_compatibility(spark, d):
    typed = W.parsed(spark, d).withColumn("p_type", F.col("definition.inputs")[0]["dataset"])
    return V.upgrade_compatibility(typed, D.API_VERSIONS, [D.STABLE_VERSION], by=["p_type"])


_MISMATCH = """concat_ws('; ',
    CASE WHEN NOT (spark IN ('4.1', '4.2') OR (provider = 'databricks' AND spark = '4.0'))
        THEN 'unsupported Spark version: ' || spark END,
    CASE WHEN dynamic AND provider = 'databricks' THEN 'workload requires dynamic allocation, provider does not support it' END,
    CASE WHEN gpu THEN 'workload requires GPU, provider does not support it' END,
    CASE WHEN streaming THEN 'workload requires streaming, provider does not support it' END)"""
_PAIRS = f"{W.FACTS} w, (SELECT unnest(['kubernetes', 'databricks']) AS provider) p"


@query(f"SELECT name, provider, {_MISMATCH} AS errors FROM {_PAIRS}")
def match_capabilities(spark, d):
    pairs = V.for_each_target(W.parsed(spark, d), _TARGETS, "provider")
    matched = V.match_capabilities(pairs, capabilities(spark), "provider")
    return matched.select("name", "provider", joined_errors(F.col("errors")).alias("errors"))


@query(
    f"""SELECT name, provider, {_MISMATCH} = '' AS valid, {_MISMATCH} AS errors,
    CASE WHEN overridden THEN 'PORTABLE_WITH_OVERRIDES' ELSE 'PORTABLE' END AS portability_status FROM {_PAIRS}"""
)
def validate_workloads(spark, d):
    pairs = V.for_each_target(W.parsed(spark, d), _TARGETS, "provider")
    checked = V.validate_workloads(pairs, capabilities(spark), "provider")
    return checked.select("name", "provider", "valid", joined_errors(F.col("errors")).alias("errors"), "portability_status")


@query(
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'PORTABLE_WITH_OVERRIDES' ELSE 'PORTABLE' END AS status,
    CASE p_brand WHEN 'Brand#1' THEN 'kubernetes=1' WHEN 'Brand#2' THEN 'databricks=0' ELSE '' END AS overrides FROM part"""
)
def portability_status(spark, d):
    overrides = F.col("definition.providerOverrides")
    listed = F.transform(
        F.map_entries(D.override_counts(overrides)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return W.parsed(spark, d).select(
        F.substring("name", 2, 20).cast("bigint").alias("p_partkey"),
        D.portability_status(overrides).alias("status"),
        F.array_join(listed, ",").alias("overrides"),
    )


@query(
    """SELECT p_type, CASE WHEN p_type = 'PROMO' THEN 'jvm' ELSE 'python' END AS language, count(*) AS workloads
    FROM part GROUP BY 1, 2"""
)
def language_of(spark, d):
    w = W.parsed(spark, d)
    return w.groupBy(
        F.col("definition.inputs")[0]["dataset"].alias("p_type"),
        D.language_of(F.col("definition.application.type")).alias("language"),
    ).agg(F.count(F.lit(1)).alias("workloads"))


_DOCUMENT_ERRORS = """SELECT c_custkey, 'Environment' AS kind, concat_ws('; ',
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'execution.provider must be kubernetes or databricks: nomad' END,
        CASE WHEN c_acctbal < 0 THEN 'missing data.profile' END) AS errors FROM customer
    UNION ALL SELECT c_custkey, 'Dataset', CASE WHEN c_mktsegment = 'BUILDING' THEN 'bindings.prod: missing identifier'
        WHEN c_acctbal < 0 THEN 'bindings.prod: kind must be path or table' ELSE '' END FROM customer
    UNION ALL SELECT c_custkey, 'Artifact', CASE WHEN c_acctbal < 0 THEN 'bindings.prod: missing uri' ELSE '' END FROM customer"""


@query(_DOCUMENT_ERRORS)
def validate_documents(spark, d):
    """Environment, dataset and artifact documents written for every customer."""
    customers = table(spark, d, "customer")
    building, indebted = F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") < 0
    named = F.struct(F.col("c_name").alias("name"), F.lit("1").alias("version")).alias("metadata")
    head = lambda kind: [F.lit("runtime/v1").alias("apiVersion"), F.lit(kind).alias("kind"), named]
    bound = lambda *fields: F.struct(F.struct(*fields).alias("prod")).alias("bindings")
    documents = {
        "Environment": F.struct(
            *head("Environment"),
            F.struct(
                F.when(building, "nomad").otherwise("kubernetes").alias("provider"), F.lit("p").alias("profile")
            ).alias("execution"),
            F.struct(F.lit("s3").alias("provider"), F.when(~indebted, "p").alias("profile")).alias("data"),
        ),
        "Dataset": F.struct(
            *head("Dataset"),
            bound(
                F.when(building, "table").when(indebted, "stream").otherwise("path").alias("kind"),
                F.when(~building, "s3a://b/x").alias("uri"),
            ),
        ),
        "Artifact": F.struct(*head("Artifact"), bound(F.when(~indebted, "s3a://b/a.whl").alias("uri"))),
    }
    checked = [
        V.validate_documents(customers.select("c_custkey", F.to_json(doc).alias("json")), kind, "json").select(
            "c_custkey", F.lit(kind).alias("kind"), joined_errors(F.col("errors")).alias("errors")
        )
        for kind, doc in documents.items()
    ]
    return checked[0].unionByName(checked[1]).unionByName(checked[2])


_VERSION = "CASE WHEN p_size < 15 THEN '4.0' WHEN p_size < 30 THEN '4.1' WHEN p_size < 40 THEN '4.2' ELSE '4.3' END"
_OVERRIDE = "CASE WHEN p_brand <> 'Brand#3' THEN concat('20.x-', lower(p_type)) END"


@query(
    f"""WITH v AS (SELECT p_partkey, {_VERSION} AS v, {_OVERRIDE} AS o FROM part),
    k AS (SELECT p_partkey, v, CASE v WHEN '4.0' THEN '17.3.x-scala2.13' WHEN '4.1' THEN '18.2.x-scala2.13'
        WHEN '4.2' THEN '19.x-scala2.13' ELSE o END AS k FROM v)
    SELECT p_partkey, k AS runtime_key, CASE
        WHEN v = '4.0' THEN NULL
        WHEN v = '4.1' THEN 'runtime key ''' || k || ''' is known as ''18.2 (Spark 4.9)'', which does not mention Spark 4.1'
        WHEN k IS NOT NULL AND NOT (v = '4.3' AND k = '20.x-promo')
            THEN 'runtime key ''' || k || ''' (curated for Spark ' || v || ') was not found in the workspace'
        END AS drift FROM k"""
)
def resolve_runtime(spark, d):
    parts = table(spark, d, "part").select(
        "p_partkey", F.expr(_VERSION).alias("spark_version"), F.expr(_OVERRIDE).alias("override")
    )
    observed = S.scan_rows(
        spark,
        [
            ("17.3.x-scala2.13", "17.3 LTS (includes Apache Spark 4.0.0)"),
            ("18.2.x-scala2.13", "18.2 (Spark 4.9)"),
            ("20.x-promo", "20 (Spark 4.3.1)"),
        ],
        "key string, name string",
    )
    return V.resolve_runtimes(parts, observed).select("p_partkey", "runtime_key", "drift")


@query(
    """SELECT s_name AS profile, CASE WHEN s_nationkey < 12 THEN 'kubernetes' ELSE 'databricks' END AS provider,
    CASE WHEN s_nationkey < 12 THEN '' ELSE '4.0,' END || '4.1,4.2' || CASE WHEN s_acctbal < 2000 THEN ',4.3' ELSE '' END
        AS spark_versions, s_nationkey < 12 AS dynamic_allocation, 'live_verified' AS verification FROM supplier"""
)
def capability_catalogue(spark, d):
    profiles = table(spark, d, "supplier").select(
        F.col("s_name").alias("profile"),
        F.when(F.col("s_nationkey") < 12, "kubernetes").otherwise("databricks").alias("provider"),
        F.when(F.col("s_acctbal") < 2000, F.array(F.lit("4.3"), F.lit("4.1"))).alias("override_versions"),
    )
    catalogue = V.capability_catalogue(profiles, capabilities(spark))
    return catalogue.select(
        "profile", "provider", F.array_join("spark_versions", ",").alias("spark_versions"), "dynamic_allocation", "verification"
    )


@query(
    f"""SELECT name, CAST(len(string_split(e, '; ')) AS BIGINT) AS n, e AS message
    FROM (SELECT name, {_ERRORS} AS e FROM {W.FACTS}) WHERE e <> ''"""
)
def collect_errors(spark, d):
    invalid = V.validate_definitions(W.parsed(spark, d)).filter(F.size("errors") > 0)
    return invalid.select("name", F.size("errors").cast("bigint").alias("n"), joined_errors(F.col("errors")).alias("message"))


_GRANTS = {"click": "Viewer", "signup": "Analyst", "purchase": "Developer", "error": "Operator", "vip": "PlatformAdmin"}
_REQUIRED = "CASE WHEN value < 10 THEN 'Viewer' WHEN value < 40 THEN 'Developer' ELSE 'Operator' END"


@query(
    f"""WITH r AS (SELECT event_id, greatest(CASE event_type WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2
            WHEN 'error' THEN 3 END, CASE WHEN value >= 100 THEN 4 END) AS rank,
        CASE {_REQUIRED} WHEN 'Viewer' THEN 0 WHEN 'Developer' THEN 2 ELSE 3 END AS needed FROM events)
    SELECT event_id, coalesce(rank >= needed, false) AS allowed FROM r"""
)
def authorize(spark, d):
    requests = table(spark, d, "events").select(
        "event_id",
        F.array_compact(F.array("event_type", F.when(F.col("value") >= 100, "vip"))).alias("groups"),
        F.expr(_REQUIRED).alias("required_role"),
    )
    return V.access_review(requests, _GRANTS).select("event_id", "allowed")


# -- native states ----------------------------------------------------------------------------------------

_OPERATOR = """CASE event_type WHEN 'click' THEN 'RunningHealthy' WHEN 'error' THEN 'SchedulingFailure'
    WHEN 'purchase' THEN 'ResourceReleased' WHEN 'signup' THEN 'SomeUnknownFutureState' END"""


def _history():
    """Entry 9 succeeded; entry 10 depends on the value; a high value adds a key that is not a number."""
    pairs = F.create_map(
        F.lit("0"), F.lit("Submitted"),
        F.lit("9"), F.lit("Succeeded"),
        F.lit("10"), F.when(F.col("value") < 20, "Failed").otherwise("RunningHealthy"),
    )
    odd = F.create_map(F.lit("x"), F.lit("Failed"))
    return F.when(F.col("value") > 80, F.map_concat(pairs, odd)).otherwise(pairs)


_OUTCOME = "CASE WHEN value > 80 THEN NULL WHEN value < 20 THEN 'Failed' ELSE 'Succeeded' END"


@query(f"SELECT event_id, {_OUTCOME} AS outcome FROM events")
def last_terminal_outcome(spark, d):
    return table(spark, d, "events").select("event_id", ST.last_terminal_outcome(_history()).alias("outcome"))


@query(
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'UNKNOWN'
        WHEN 'view' THEN 'SUBMITTING' ELSE CASE {_OUTCOME} WHEN 'Failed' THEN 'FAILED' WHEN 'Succeeded' THEN 'SUCCEEDED'
        ELSE 'UNKNOWN' END END AS state,
    CASE WHEN event_type = 'purchase' THEN coalesce({_OUTCOME}, 'ResourceReleased')
        WHEN event_type = 'view' THEN 'Unreported' ELSE {_OPERATOR} END AS native FROM events"""
)
def canonical_states_operator(spark, d):
    mapped = ST.operator_state(F.expr(_OPERATOR), _history())
    return table(spark, d, "events").select("event_id", mapped.alias("s")).select("event_id", "s.*")


_LIFE = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'PENDING' WHEN o_orderpriority = '2-HIGH' THEN 'TERMINATED'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'INTERNAL_ERROR' WHEN o_orderpriority = '5-LOW' THEN 'NEW_STATE' END"""
_RESULT = "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'TIMEDOUT' END"


@query(
    f"""WITH s AS (SELECT o_orderkey, {_LIFE} AS life, {_RESULT} AS result, o_totalprice >= 20000 AS reported FROM orders)
    SELECT o_orderkey, CASE WHEN NOT reported THEN 'UNKNOWN' WHEN life = 'PENDING' THEN 'QUEUED'
        WHEN life = 'INTERNAL_ERROR' THEN 'FAILED' WHEN life = 'TERMINATED' AND result = 'SUCCESS' THEN 'SUCCEEDED'
        WHEN life = 'TERMINATED' AND result = 'TIMEDOUT' THEN 'FAILED' ELSE 'UNKNOWN' END AS state,
    CASE WHEN NOT reported THEN 'UNREPORTED' WHEN life = 'TERMINATED' AND result IS NOT NULL THEN life || '/' || result
        ELSE coalesce(life, 'UNKNOWN') END AS native FROM s"""
)
def canonical_states_jobs(spark, d):
    mapped = ST.jobs_state(F.expr(_LIFE), F.expr(_RESULT), F.expr("o_totalprice >= 20000"))
    return table(spark, d, "orders").select("o_orderkey", mapped.alias("s")).select("o_orderkey", "s.*")


_END = "CASE WHEN o_orderstatus <> 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) * 10000 END"


@query(
    f"""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN epoch_us(o_orderdate) END AS b,
        coalesce(epoch_us(o_orderdate) + {_END}, epoch_us(timestamp '1999-01-01')) AS e FROM orders),
    t AS (SELECT o_orderkey, greatest(0, CAST(floor((e - b) / 1000000.0 + 0.5) AS BIGINT)) AS s, b FROM s)
    SELECT o_orderkey, CASE WHEN b IS NULL THEN '—' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's'
        ELSE s || 's' END AS duration FROM t"""
)
def format_durations(spark, d):
    start = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp"))
    end = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.expr(_END))
    duration = ST.format_duration(start, end, F.lit("1999-01-01").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", duration.alias("duration"))
