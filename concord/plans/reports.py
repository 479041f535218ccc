"""Counts, latencies, certification, reliability, subscriptions and signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from concord.operators import events as E
from concord.operators import lifecycle as L
from concord.operators import reports as R
from concord.plans import lifecycle as PL
from concord.sources import datasets as S
from concord.plans.registry import query, table


@query("SELECT o_orderstatus AS state, count(*) AS runs FROM orders GROUP BY 1")
def state_counts(spark, d):
    return R.state_counts(table(spark, d, "orders"), "o_orderstatus")


@query(f"SELECT count(*) FILTER (WHERE winner = event_id) AS runs_created FROM ({PL.IDEMPOTENT_SQL})")
def runs_created(spark, d):
    return R.runs_created(L.idempotent_first(PL.submissions(spark, d), "key", "event_id", ["ts", "event_id"]))


@query("SELECT event_type AS state, count(*) AS transitions FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def terminal_transitions(spark, d):
    return R.terminal_transitions(table(spark, d, "events"), "event_type", ["purchase", "error"])


_STATUS = "CASE WHEN value < 30 THEN 200 WHEN value < 60 THEN 404 WHEN value < 90 THEN 503 END"


@query(
    f"""SELECT event_type AS method, props AS route, CAST(coalesce({_STATUS}, 500) AS BIGINT) AS status_code, count(*) AS errors
    FROM events WHERE coalesce({_STATUS}, 500) >= 400 GROUP BY 1, 2, 3"""
)
def api_errors(spark, d):
    requests = table(spark, d, "events").select(
        F.col("event_type").alias("method"), F.col("props").alias("route"), F.expr(_STATUS).alias("status_code")
    )
    return R.api_errors(requests).withColumn("status_code", F.col("status_code").cast("bigint"))


@query("SELECT props AS provider, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 10 GROUP BY 1")
def provider_errors(spark, d):
    events = table(spark, d, "events").withColumnRenamed("props", "provider")
    return R.provider_errors(events, "event_type = 'error' AND value > 10")


@query(f"SELECT category, disposition, provider, count(*) AS failures FROM ({PL.FAILURE_SQL}) GROUP BY ALL")
def failure_breakdown(spark, d):
    return R.failure_breakdown(PL.failures(spark, d))


@query(
    """SELECT user_id AS identity, event_type AS action, CASE WHEN value < 50 THEN 'success' ELSE 'failure' END AS result,
    count(*) AS actions FROM events GROUP BY ALL"""
)
def audit_summary(spark, d):
    audit = table(spark, d, "events").select(
        F.col("user_id").alias("identity"),
        F.col("event_type").alias("action"),
        F.when(F.col("value") < 50, "success").otherwise("failure").alias("result"),
    )
    return R.audit_summary(audit)


_HOUR = 3_600_000_000
_BOUNDS = [_HOUR, 6 * _HOUR, 24 * _HOUR, 72 * _HOUR, 240 * _HOUR]
_LES = [(str(b), f"micros <= {b}") for b in _BOUNDS] + [("+Inf", "true")]


@query(
    f"""WITH m AS ({PL.LATENCY_SQL}), b AS ("""
    + " UNION ALL ".join(f"SELECT latency, '{le}' AS le, count(*) FILTER (WHERE {c}) AS cumulative FROM m GROUP BY 1" for le, c in _LES)
    + """) SELECT b.*, t.count AS "count", t.total FROM b JOIN (SELECT latency, count(*) AS count,
        CAST(sum(micros) AS BIGINT) AS total FROM m GROUP BY 1) t USING (latency)"""
)
def latency_histogram(spark, d):
    return R.latency_histogram(PL.measured(spark, d), _BOUNDS)


@query(
    """SELECT event_type AS process, epoch_us(timestamp '2024-02-01') - epoch_us(max(ts)) AS lag_micros
    FROM events WHERE value < 50 GROUP BY 1"""
)
def reconciliation_lag(spark, d):
    loops = table(spark, d, "events").select(F.col("event_type").alias("process"), F.col("ts").alias("finished_at"), "value")
    return R.reconciliation_lag(loops, F.lit("2024-02-01").cast("timestamp"), success=F.col("value") < 50)


_PROVIDER = "CASE WHEN o_orderpriority < '4' THEN 'kubernetes' ELSE 'databricks' END"
_OVERRIDES = "CASE WHEN o_totalprice < 8000 THEN 1 ELSE 0 END"


@query(
    f"""WITH w AS (SELECT o_custkey, count(DISTINCT {_PROVIDER}) AS p, max({_OVERRIDES}) AS o FROM orders GROUP BY 1)
    SELECT count(*) AS workloads, count(*) FILTER (WHERE p >= 2 AND o = 0) AS portable FROM w"""
)
def portability_rate(spark, d):
    executions = table(spark, d, "orders").select(
        F.col("o_custkey").alias("workload"), F.expr(_PROVIDER).alias("provider"), F.expr(_OVERRIDES).alias("overrides")
    )
    return R.portability_rate(executions)


_STATE = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'LOST' ELSE 'RUNNING' END"
_RUN = "concat(user_id, '/', substr(props, 7, 1))"
_CATEGORY = "CASE WHEN value > 40 THEN 'UNKNOWN_RECONCILIATION' ELSE 'VALIDATION' END"


@query(
    f"""WITH e AS (SELECT {_RUN} AS run_id, {_STATE} AS s, {_CATEGORY} AS c, event_id,
        {PL._KEY} AS key FROM events),
    r AS (SELECT run_id, bool_or(s = 'QUEUED') AS q, bool_or(s = 'FAILED' AND c = 'UNKNOWN_RECONCILIATION') AS f,
        bool_or(s = 'LOST') AS l FROM e GROUP BY 1)
    SELECT count(*) FILTER (WHERE q) AS submitted, count(*) FILTER (WHERE f) AS reconciliation_failures,
    count(*) FILTER (WHERE l) AS lost,
    (SELECT count(key) - count(DISTINCT key) FROM e) AS duplicate_executions FROM r"""
)
def run_reliability(spark, d):
    events = PL.submissions(spark, d).select(
        F.expr(_RUN).alias("run_id"), F.expr(_STATE).alias("to_state"), F.expr(_CATEGORY).alias("category"), "key"
    )
    return R.run_reliability(events, events)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def unpolled_runs(spark, d):
    runs = table(spark, d, "orders").withColumn(
        "state", F.expr("CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE 'UNKNOWN' END")
    )
    return R.unpolled_runs(runs).select("o_orderkey")


# -- certification ----------------------------------------------------------------------------------------


def _certification(spark, d, worst):
    customers = table(spark, d, "customer")
    environments = customers.select(
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("execution_profile_name"),
        F.col("c_nationkey").cast("string").alias("storage_profile_name"),
    )
    execution = customers.select(F.col("c_mktsegment").alias("name")).distinct().select(
        "name",
        F.expr("CASE WHEN name IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'kubernetes' ELSE 'databricks' END").alias(
            "provider"
        ),
        F.when(F.col("name") == "BUILDING", F.array().cast("array<string>")).otherwise(F.array(F.lit("4.1"))).alias(
            "spark_versions"
        ),
        F.when(F.col("name") == "MACHINERY", "provider unreachable").alias("check_error"),
    )
    storage = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("name"),
        F.expr("CASE n_regionkey WHEN 0 THEN 's3' WHEN 1 THEN 'adls' ELSE 'vast' END").alias("provider"),
        F.expr("""CASE WHEN n_regionkey = 2 THEN '{"protocol":"nfs"}' ELSE '{}' END""").alias("config"),
    )
    evidence = S.scan_rows(
        spark,
        [("kubernetes", "s3"), ("databricks", "s3")], "execution_provider string, storage_protocol string"
    )
    return R.certification_report(environments, execution, storage, evidence, worst)


def _certification_sql(order: str) -> str:
    return f"""WITH e AS (SELECT c_name, c_mktsegment IN ('BUILDING', 'MACHINERY') AS broken,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'execution provider reports no supported Spark versions'
            WHEN 'MACHINERY' THEN 'provider unreachable' END AS why,
        CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'kubernetes' ELSE 'databricks' END AS execution_provider,
        CASE n_regionkey WHEN 0 THEN 's3' WHEN 1 THEN 'adls' WHEN 2 THEN 'vast-nfs' ELSE 'vast-s3' END AS storage_protocol
        FROM customer JOIN nation ON c_nationkey = n_nationkey),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY execution_provider, storage_protocol ORDER BY {order}) = 1)
    SELECT execution_provider, storage_protocol,
        CASE WHEN broken THEN 'FAIL' WHEN storage_protocol = 's3' THEN 'PASS' ELSE 'BLOCKED' END AS status,
        CASE WHEN broken THEN why WHEN storage_protocol <> 's3' THEN 'this exact pair has no live evidence' END AS detail FROM f"""


@query(_certification_sql("c_name"))
def certification_report(spark, d):
    return _certification(spark, d, False)


@query(_certification_sql("broken DESC, c_name"))
def certification_report_worst(spark, d):
    return _certification(spark, d, True)


# -- legs of a comparison ---------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT o_orderkey AS position, CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS w, o_orderstatus AS s,
        n_name, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT s_suppkey, s_name, NULL, NULL, NULL, NULL FROM supplier),
    x AS (SELECT *, CASE WHEN s IS NULL THEN 'run ''' || run_id || ''' not found'
        WHEN s <> 'F' THEN 'run not SUCCEEDED (state=' || CASE s WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END || ')'
        WHEN w = '5-LOW' THEN 'workload declares no output datasets'
        WHEN w = '4-NOT SPECIFIED' THEN 'workload has no output named ''report'''
        WHEN n_regionkey >= 3 THEN 'no dataset binding for ''' || w || '.out'' in ''' || n_name || '''' END AS reason FROM r)
    SELECT position, run_id, coalesce(n_name, run_id) AS environment_name,
        CASE WHEN reason IS NULL THEN 's3a://' || n_name || '/' || w END AS uri, reason FROM x"""
)
def resolve_legs(spark, d):
    """Every order is a run of its priority's workload; suppliers are asked for as runs that do not exist."""
    orders, nation = table(spark, d, "orders"), table(spark, d, "nation")
    runs = (
        orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_orderpriority").alias("workload_name"),
            F.lit("1").alias("workload_version"),
            F.col("n_name").alias("environment_name"),
            F.expr("CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END").alias("state"),
        )
    )
    priorities = orders.select(F.col("o_orderpriority").alias("name")).distinct()
    output = F.struct(
        F.when(F.col("name") == "4-NOT SPECIFIED", "other").otherwise("report").alias("name"),
        F.concat("name", F.lit(".out")).alias("dataset"),
    )
    outputs = F.when(F.col("name") == "5-LOW", F.array().cast("array<struct<name:string,dataset:string>>")).otherwise(
        F.array(output)
    )
    definitions = priorities.select("name", F.lit("1").alias("version"), F.struct(outputs.alias("outputs")).alias("definition"))
    places = nation.filter("n_regionkey < 3").select(F.col("n_name").alias("environment_name"))
    bindings = (
        runs.select("environment_name", "workload_name")
        .distinct()
        .join(places, "environment_name")
        .select(
            F.concat("workload_name", F.lit(".out")).alias("dataset_name"),
            "environment_name",
            F.lit("path").alias("kind"),
            F.concat(F.lit("s3a://"), "environment_name", F.lit("/"), "workload_name").alias("uri"),
        )
    )
    requested = orders.select(F.col("o_orderkey").alias("position"), F.col("o_orderkey").cast("string").alias("run_id")).unionByName(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("run_id"))
    )
    legs = R.resolve_legs(requested, runs, definitions, bindings, "report")
    return legs.select("position", "run_id", "environment_name", "uri", "reason")


# -- subscriptions ----------------------------------------------------------------------------------------

STATES = ["click", "error", "purchase", "signup", "view"]
SUBSCRIPTIONS = [
    ("a", ["run.error", "run.purchase"], "alpha", True),
    ("b", ["run.state_changed"], "beta", True),
    ("c", ["run.view", "run.state_changed", "run.view"], "a much longer secret " * 5, True),
    ("d", ["run.click"], "delta", False),
]


def subscriptions(spark):
    return S.scan_rows(
        spark,
        SUBSCRIPTIONS, "subscription_id string, event_types array<string>, secret string, enabled boolean"
    )


MATCH_SQL = """SELECT event_id, s AS subscription_id, 'run.' || event_type AS event_type FROM events,
    (SELECT unnest(['a', 'b', 'c']) AS s) WHERE s <> 'a' OR event_type IN ('error', 'purchase')"""


@query(
    """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events)
    SELECT event_id, s AS subscription_id, 'run.' || event_type AS event_type FROM l,
    (SELECT unnest(['a', 'b', 'c']) AS s) WHERE (s <> 'a' OR event_type IN ('error', 'purchase')) AND previous_state IS NOT NULL"""
)
def match_subscriptions(spark, d):
    """A run's first event notifies nobody."""
    events = L.transitions(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    matched = E.match_subscriptions(events, subscriptions(spark).drop("secret"), "event_type", STATES, None, "previous_state")
    return matched.select("event_id", "subscription_id", "event_type")


_ISO = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
    ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"""
_PAYLOAD_SQL = f"""'{{"run_id": "' || user_id || '", "workload_name": "w", "workload_version": "1", "environment_name": null, '
    || '"from_state": null, "to_state": "' || event_type || '", "message": ' || CAST(to_json(props) AS VARCHAR)
    || ', "timestamp": "' || {_ISO} || '"}}'"""


def _payload():
    none = F.lit(None).cast("string")
    return E.event_payload(
        F.col("user_id"), F.lit("w"), F.lit("1"), none, none, F.col("event_type"), F.col("props"), F.col("ts")
    )


@query(f"SELECT event_id, {_PAYLOAD_SQL} AS payload FROM events")
def event_payload(spark, d):
    return table(spark, d, "events").select("event_id", _payload().alias("payload"))


def _pad(secret: str, byte: int) -> str:
    raw = secret.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    return bytes(b ^ byte for b in raw.ljust(64, b"\0")).hex()


def _signature_sql(text: str, secret: str) -> str:
    inner = f"unhex(sha256(unhex('{_pad(secret, 0x36)}') || encode({text})))"
    return f"sha256(unhex('{_pad(secret, 0x5C)}') || {inner})"


@query(
    " UNION ALL ".join(
        f"SELECT event_id, '{s}' AS subscription_id, {_signature_sql(_PAYLOAD_SQL, secret)} AS signature FROM events"
        + (" WHERE event_type IN ('error', 'purchase')" if s == "a" else "")
        for s, _, secret, enabled in SUBSCRIPTIONS
        if enabled
    )
)
def hmac_signature(spark, d):
    """Payloads, rendered once per event, signed with the secret of each matching subscription."""
    bodies = table(spark, d, "events").select("event_id", "event_type", _payload().alias("payload"))
    matched = E.match_subscriptions(bodies, subscriptions(spark).drop("secret"), "event_type", STATES)
    return E.signed_deliveries(matched, subscriptions(spark)).select("event_id", "subscription_id", "signature")
