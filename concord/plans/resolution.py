"""Dataset and artifact resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import uri as U
from concord.operators import resolve as R
from concord.plans import workloads as W
from concord.plans.registry import query, table

_REFS = f"""SELECT name, environment_name, direction, ref, dataset FROM (
    SELECT name, environment_name, 'input' AS direction, 'src' AS ref, p_type AS dataset FROM {W.FACTS}
    UNION ALL SELECT name, environment_name, 'output', 'out', p_name FROM {W.FACTS}
    UNION ALL SELECT name, environment_name, 'output', 'again', p_brand FROM {W.FACTS})"""


def _refs(spark, d):
    return R.dataset_refs(W.parsed(spark, d), keep=("name", "environment_name"))


@query(_REFS)
def dataset_refs(spark, d):
    return _refs(spark, d)


_RESOLVED = f"""WITH r AS ({_REFS}), b AS ({W.BINDINGS}), k AS (SELECT DISTINCT dataset_name FROM b)
    SELECT r.*, b.kind,
        CASE WHEN b.uri IS NOT NULL THEN 'spark.portable.dataset.' || r.dataset
            || CASE WHEN b.kind = 'table' THEN '.identifier' ELSE '.uri' END END AS config_key,
        CASE WHEN b.kind = 'table' THEN 'lakehouse.' || b.uri ELSE b.uri END AS config_value,
        CASE WHEN k.dataset_name IS NULL THEN 'no Dataset definition found for ''' || r.dataset || ''''
            WHEN b.uri IS NULL THEN 'dataset ''' || r.dataset || ''' has no binding for environment '''
                || r.environment_name || '''' END AS error
    FROM r LEFT JOIN b ON b.dataset_name = r.dataset AND b.environment_name = r.environment_name
    LEFT JOIN k ON k.dataset_name = r.dataset"""


@query(_RESOLVED)
def resolve_datasets(spark, d):
    return R.resolve_datasets(_refs(spark, d), W.bindings(spark, d))


_PROFILES = """SELECT DISTINCT p_brand AS environment_name, 'https://catalog/' || p_brand AS catalog_uri,
    CASE WHEN p_brand < 'Brand#2' THEN 's3://lake/' || p_brand END AS catalog_warehouse FROM part"""
_CATALOG_ROWS = [
    ("'spark.sql.extensions'", "'org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions'"),
    ("'spark.sql.catalog.lakehouse'", "'org.apache.iceberg.spark.SparkCatalog'"),
    ("'spark.sql.catalog.lakehouse.type'", "'rest'"),
    ("'spark.sql.catalog.lakehouse.client.region'", "'us-east-1'"),
    ("'spark.sql.catalog.lakehouse.uri'", "catalog_uri"),
    ("'spark.sql.catalog.lakehouse.warehouse'", "catalog_warehouse"),
]


@query(
    f"""WITH n AS (SELECT DISTINCT x.name, p.* FROM ({_RESOLVED}) x JOIN ({_PROFILES}) p USING (environment_name)
        WHERE x.kind = 'table')
    SELECT name, environment_name, NULL AS config_key, NULL AS config_value, 'a table dataset binding is present but the '
        || 'environment''s storage profile has no catalog uri or warehouse' AS error FROM n WHERE catalog_warehouse IS NULL
    UNION ALL """
    + " UNION ALL ".join(
        f"SELECT name, environment_name, {k}, {v}, NULL FROM n WHERE catalog_warehouse IS NOT NULL" for k, v in _CATALOG_ROWS
    )
)
def catalog_requirement(spark, d):
    resolved = R.resolve_datasets(_refs(spark, d), W.bindings(spark, d))
    profiles = table(spark, d, "part").select(F.col("p_brand").alias("environment_name")).distinct().select(
        "environment_name",
        F.concat(F.lit("https://catalog/"), "environment_name").alias("catalog_uri"),
        F.when(F.col("environment_name") < "Brand#2", F.concat(F.lit("s3://lake/"), "environment_name")).alias(
            "catalog_warehouse"
        ),
    )
    return R.catalog_requirement(resolved, profiles)


_REFERENCE = """CASE WHEN p_size < 10 THEN concat('local:///opt/', p_name)
    WHEN p_size < 15 THEN concat('artifact://', p_brand)
    ELSE concat('artifact://', p_brand, '/', p_type, '/', p_size) END"""


@query(
    f"""WITH r AS (SELECT p_partkey, {_REFERENCE} AS reference, p_size FROM part),
    p AS (SELECT *, regexp_extract(reference, '^artifact://([^/]+)/(.+)$', 1) AS n,
        regexp_extract(reference, '^artifact://([^/]+)/(.+)$', 2) AS v FROM r)
    SELECT p_partkey, nullif(n, '') AS name, nullif(v, '') AS version,
        CASE WHEN p_size < 10 THEN 'not an artifact:// reference: ' || reference
            WHEN n = '' THEN 'malformed artifact reference (expected artifact://<name>/<version>): ' || reference END AS error
    FROM p"""
)
def parse_artifacts(spark, d):
    parts = table(spark, d, "part").withColumn("reference", F.expr(_REFERENCE))
    return parts.select("p_partkey", F.inline(F.array(U.parse_artifact(F.col("reference")))))


_ARTIFACT_BINDINGS = """SELECT DISTINCT p_brand AS artifact_name, concat(p_type, '/', p_size) AS artifact_version,
    p_brand AS environment_name, concat('s3a://artifacts/', p_brand, '/', p_type) AS uri
    FROM part WHERE p_type IN ('PROMO', 'LARGE')"""


@query(
    f"""WITH r AS (SELECT p_partkey, p_brand, p_type, p_size, {_REFERENCE} AS reference FROM part)
    SELECT p_partkey, CASE WHEN p_size < 10 THEN reference
            WHEN p_size >= 15 AND p_type IN ('PROMO', 'LARGE') THEN 's3a://artifacts/' || p_brand || '/' || p_type END AS resolved,
        CASE WHEN p_size >= 10 AND p_size < 15
                THEN 'malformed artifact reference (expected artifact://<name>/<version>): ' || reference
            WHEN p_size >= 15 AND p_type NOT IN ('PROMO', 'LARGE') THEN 'artifact ''' || p_brand || '/' || p_type || '/' || p_size
                || ''' has no binding for environment ''' || p_brand || '''' END AS error
    FROM r"""
)
def resolve_artifacts(spark, d):
    parts = table(spark, d, "part")
    refs = parts.select("p_partkey", F.expr(_REFERENCE).alias("reference"), F.col("p_brand").alias("environment_name"))
    bindings = spark.sql(_ARTIFACT_BINDINGS.replace("FROM part", "FROM {part}"), part=parts)
    return R.resolve_artifacts(refs, bindings).select("p_partkey", "resolved", "error")


@query(
    """SELECT o_custkey, o_orderpriority AS key, o_orderstatus AS value FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1"""
)
def merge_config(spark, d):
    layers = table(spark, d, "orders").select(
        "o_custkey",
        F.col("o_orderpriority").alias("key"),
        F.col("o_orderkey").alias("priority"),
        F.col("o_orderstatus").alias("value"),
    )
    return R.merge_config(layers, ("o_custkey",))


@query(
    """SELECT p_partkey, CASE WHEN p_size < 20 THEN 'dataset' WHEN p_type = 'PROMO' THEN 'storage' ELSE 'base' END AS endpoint,
    p_brand AS brand FROM part"""
)
def merge_config_maps(spark, d):
    """Base, storage and dataset settings of one row; the later map wins."""
    base = F.create_map(F.lit("endpoint"), F.lit("base"), F.lit("brand"), F.col("p_brand"))
    storage = F.when(F.col("p_type") == "PROMO", F.create_map(F.lit("endpoint"), F.lit("storage")))
    dataset = F.when(F.col("p_size") < 20, F.create_map(F.lit("endpoint"), F.lit("dataset")))
    merged = R.merged_maps(base, storage, dataset)
    return table(spark, d, "part").select("p_partkey", merged["endpoint"].alias("endpoint"), merged["brand"].alias("brand"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 1) AS scheme,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 2) AS bucket,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 3) AS path,
    'unsupported URI scheme: ' || url AS error FROM pages"""
)
def split_uri(spark, d):
    url = F.col("url")
    parts = U.split_uri(url).alias("u")
    return (
        table(spark, d, "pages")
        .select("page_id", parts, U.comparable_uri_error(url).alias("error"))
        .select("page_id", "u.*", "error")
    )


_PROTOCOL = "CASE lang WHEN 'en' THEN 's3' WHEN 'de' THEN 'adls' WHEN 'fr' THEN 'vast-nfs' ELSE 'vast-s3' END"
_WHERE = """CASE WHEN n_chars < 500 THEN concat('s3a://', source, '/', doc_id)
    WHEN n_chars < 1500 THEN concat('abfss://data@acct.dfs.core.windows.net/', doc_id)
    WHEN n_chars < 3000 THEN concat('/mnt/vast/', doc_id) ELSE concat('http://x/', doc_id) END"""


@query(
    f"""WITH u AS (SELECT doc_id, {_PROTOCOL} AS protocol, {_WHERE} AS uri FROM documents),
    e AS (SELECT doc_id, CASE
        WHEN protocol IN ('s3', 'vast-s3') AND NOT (uri LIKE 's3a://%' OR uri LIKE 's3://%') THEN 'not an S3 URI: ' || uri
        WHEN protocol = 'adls' AND NOT uri LIKE 'abfss://data@acct.dfs.core.windows.net/%'
            THEN 'outside abfss://data@acct.dfs.core.windows.net/: ' || uri
        WHEN protocol = 'vast-nfs' AND NOT uri LIKE '/mnt/vast/%' THEN 'outside /mnt/vast/: ' || uri END AS uri_error FROM u)
    SELECT doc_id, uri_error IS NULL AS uri_valid, uri_error FROM e"""
)
def validate_uri(spark, d):
    error = U.uri_error(
        F.expr(_PROTOCOL), F.expr(_WHERE), F.lit("data"), F.lit("acct"), F.lit("/mnt/vast/")
    )
    return table(spark, d, "documents").select("doc_id", error.isNull().alias("uri_valid"), error.alias("uri_error"))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 's3' WHEN c_mktsegment = 'BUILDING' THEN 'adls'
    WHEN c_acctbal < 0 THEN 'vast-nfs' ELSE 'vast-s3' END AS protocol FROM customer"""
)
def storage_protocols(spark, d):
    provider = F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 's3' WHEN 'BUILDING' THEN 'adls' ELSE 'vast' END")
    config = F.when(F.col("c_acctbal") < 0, '{"protocol":"nfs"}').otherwise("{}")
    return table(spark, d, "customer").select("c_custkey", U.storage_protocol(provider, config).alias("protocol"))
