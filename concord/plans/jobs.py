"""Example jobs, scans, sinks and stored views."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from concord.operators import jobs as J
from concord.plans.registry import cents, query, table
from concord.session import scratch
from concord.sources import datasets as S


@query(
    r"""SELECT word, count(*) AS "count" FROM (
        SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents)
    WHERE word <> '' GROUP BY 1"""
)
def word_count(spark, d):
    return J.word_count(table(spark, d, "documents"), "text")


@query(
    """SELECT c.c_custkey AS claim_id, c.c_nationkey AS provider_id, upper(n.n_name) AS provider_name,
        r.n_regionkey AS specialty, c.c_acctbal AS amount, c.c_mktsegment AS service_date,
        n.n_name IS NOT NULL AS provider_matched,
        CASE WHEN c.c_acctbal >= 1000 THEN 'high' WHEN c.c_acctbal >= 100 THEN 'medium' ELSE 'low' END AS amount_band
    FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) r ON c.c_nationkey = r.n_nationkey"""
)
def join_and_normalize(spark, d):
    claims = table(spark, d, "customer").select(
        F.col("c_custkey").alias("claim_id"),
        F.col("c_nationkey").alias("provider_id"),
        F.col("c_acctbal").cast("string").alias("amount"),
        F.col("c_mktsegment").alias("service_date"),
    )
    reference = table(spark, d, "nation").filter("n_regionkey < 3").select(
        F.col("n_nationkey").alias("provider_id"),
        F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("provider_name"),
        F.col("n_regionkey").alias("specialty"),
    )
    return J.join_and_normalize(claims, reference)


def _totals(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"),
        F.sum(F.round(F.col("o_totalprice").cast("double") * 100).cast("bigint")).alias("cents"),
        F.sum(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("seconds"),
        F.sum(F.length("o_orderstatus") + F.length("o_orderpriority") + F.col("o_custkey").cast("bigint")).alias("rest"),
    ).select(F.lit(label).alias("format"), "rows", "keys", "cents", "seconds", "rest")


_TOTALS = """count(*) AS "rows", CAST(sum(o_orderkey) AS BIGINT) AS keys,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(sum(epoch_us(o_orderdate) // 1000000) AS BIGINT) AS seconds,
    CAST(sum(length(o_orderstatus) + length(o_orderpriority) + o_custkey) AS BIGINT) AS rest FROM orders"""


@query(
    " UNION ALL ".join(f"SELECT '{f}' AS format, {_TOTALS}" for f in ("parquet", "orc", "json", "csv"))
    + " UNION ALL SELECT 'text', count(*), CAST(sum(o_orderkey) AS BIGINT), 0, 0, 0 FROM orders"
    + " UNION ALL SELECT 'rows', count(DISTINCT o_orderstatus), 0, 0, 0, 0 FROM orders"
)
def scan_sink_roundtrip(spark, d):
    """All columns of orders through every file format."""
    orders = table(spark, d, "orders")
    root = scratch(spark, "formats")
    parts = []
    for form in ("parquet", "orc", "json", "csv"):
        S.sink(orders, "path", f"{root}/{form}", format=form)
        parts.append(_totals(S.scan(spark, "path", f"{root}/{form}", form), form))
    S.sink(orders.select(F.col("o_orderkey").cast("string")), "path", f"{root}/text", format="text")
    nothing = F.lit(0).cast("bigint")
    lines = S.scan_text(spark, f"{root}/text").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("bigint")).alias("keys"))
    parts.append(lines.select(F.lit("text").alias("format"), "rows", "keys", *[nothing.alias(c) for c in ("cents", "seconds", "rest")]))
    known = S.scan_rows(spark, [("F",), ("O",), ("P",)], "o_orderstatus string")
    used = known.join(orders, "o_orderstatus", "left_semi")
    parts.append(
        used.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit("rows").alias("format"), "rows", *[nothing.alias(c) for c in ("keys", "cents", "seconds", "rest")]
        )
    )
    return reduce(DataFrame.unionByName, parts)


def _schema_in_scratch(spark, label: str) -> str:
    root = scratch(spark, label)
    name = root.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{root}'")
    return name


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, count(c_custkey) AS customers, true AS second_create_fails
    FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2"""
)
def table_roundtrip(spark, d):
    """Create a table by its logical name, find it again by the same name and dump it to a path dataset."""
    schema = _schema_in_scratch(spark, "tables")
    bindings = spark.createDataFrame(
        [
            ("demo.table", "prod", "table", f"{schema}.demo"),
            ("demo.readback", "prod", "path", f"{scratch(spark, 'readback')}"),
        ],
        "dataset_name string, environment_name string, kind string, uri string",
    )
    customers = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"))
    rows = (
        table(spark, d, "nation")
        .join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("label"),
            F.coalesce("customers", F.lit(0).cast("bigint")).alias("customers"),
        )
    )
    S.write_dataset(rows, "demo.table", "prod", bindings, catalog=None)
    try:
        S.write_dataset(rows, "demo.table", "prod", bindings, catalog=None)
        refused = False
    except PySparkException:
        refused = True
    found = S.read_dataset(spark, "demo.table", "prod", bindings, catalog=None)
    S.write_dataset(found, "demo.readback", "prod", bindings, format="json")
    spark.sql(f"DROP SCHEMA {schema} CASCADE")
    dumped = S.read_dataset(spark, "demo.readback", "prod", bindings, format="json")
    return dumped.select("id", "label", "customers", F.lit(refused).alias("second_create_fails"))


@query(
    """SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1"""
)
def materialize_view(spark, d):
    """Two views, the second computed from the first."""
    schema = _schema_in_scratch(spark, "views")
    for name in ("orders", "customer"):
        table(spark, d, name).createOrReplaceTempView(f"{schema}_{name}")
    S.materialize_views(
        spark,
        {
            f"{schema}.finished": f"""SELECT c_mktsegment, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
                FROM {schema}_orders JOIN {schema}_customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
            f"{schema}.by_segment": f"""SELECT c_mktsegment, count(*) AS orders, sum(cents) AS cents
                FROM {schema}.finished GROUP BY c_mktsegment""",
        },
    )
    copy = scratch(spark, "by-segment")
    S.sink(S.scan(spark, "table", f"{schema}.by_segment"), "path", copy)
    spark.sql(f"DROP SCHEMA {schema} CASCADE")
    for name in ("orders", "customer"):
        spark.catalog.dropTempView(f"{schema}_{name}")
    return S.scan(spark, "path", copy)


@query(
    """SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders GROUP BY 1"""
)
def configured_job(spark, d):
    """A job that finds its input and output through ``spark.portable.dataset.*`` settings and arguments."""
    output = scratch(spark, "output")
    settings = {"SPARK_PORTABLE_DATASET_ORDERS_RAW_URI": f"{d}/orders.parquet"}
    arguments = [f"--spark.portable.dataset.orders.summary.uri={output}"]
    find = lambda name: S.dataset_location(spark, name, environ=settings, argv=arguments)
    orders = S.scan(spark, *find("orders.raw"))
    summary = orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("cents")
    )
    S.sink(summary, *find("orders.summary"))
    return S.scan(spark, *find("orders.summary"))
