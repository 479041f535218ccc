"""Run-history queries: ``events`` plays the event log (user = run, event type = state), ``orders`` the runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import lifecycle as L
from concord.plans.registry import cents, micros, query, table

_EVENT_ORDER = ["ts", "event_id"]
_RUN = {"key": "user_id", "state": "event_type", "order": _EVENT_ORDER}
_BY_RUN = "PARTITION BY user_id ORDER BY ts, event_id"
_EARLIER = f"({_BY_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = f"({_BY_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _events(spark, d):
    return table(spark, d, "events")


@query(
    """SELECT user_id, event_id, event_type, props, epoch_us(ts) AS at_us FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def latest_per_key(spark, d):
    latest = L.latest_per_key(_events(spark, d), ["user_id"], _EVENT_ORDER)
    return latest.select("user_id", "event_id", "event_type", "props", micros("ts").alias("at_us"))


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def latest_definition(spark, d):
    latest = L.latest_definition(
        table(spark, d, "orders"), name_col="o_custkey", order=["o_orderdate", "o_orderkey"]
    )
    return latest.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM'")
def definition_version(spark, d):
    exact = L.latest_definition(table(spark, d, "orders"), "3-MEDIUM", "o_custkey", "o_orderpriority")
    return exact.select("o_custkey", "o_orderkey")


@query(
    """SELECT user_id, event_type AS state FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def current_state(spark, d):
    return L.current_state(_events(spark, d), "user_id", "event_type", _EVENT_ORDER)


@query("SELECT user_id, epoch_us(max(ts)) AS entered_us FROM events WHERE event_type = 'purchase' GROUP BY 1")
def latest_event_into_state(spark, d):
    entered = L.latest_event_into_state(_events(spark, d), "purchase", "user_id", "event_type", "ts")
    return entered.select("user_id", micros("entered_at").alias("entered_us"))


_STORED = "CASE WHEN value < 100 THEN 'view' END"


@query(
    f"""SELECT event_id, event_type, lag(event_type) OVER ({_BY_RUN}) AS previous_state,
    ({_STORED}) IS NOT DISTINCT FROM lag(event_type) OVER ({_BY_RUN}) AS consistent FROM events"""
)
def transitions(spark, d):
    events = _events(spark, d).withColumn("stored", F.expr(_STORED))
    return L.transitions(events, stored="stored", **_RUN).select("event_id", "event_type", "previous_state", "consistent")


LATENCY_SPEC = {"queue": ("signup", ("purchase",)), "execution": ("view", ("error", "click"))}
_SEEN = f"""SELECT *, lag(event_type) OVER ({_BY_RUN}) AS previous_state,
    max(CASE WHEN event_type = 'signup' THEN ts END) OVER {_EARLIER} AS signup_at,
    max(CASE WHEN event_type = 'view' THEN ts END) OVER {_EARLIER} AS view_at FROM events"""
LATENCY_SQL = f"""WITH s AS ({_SEEN}),
    c AS (SELECT * FROM s WHERE previous_state IS DISTINCT FROM event_type AND previous_state IS DISTINCT FROM 'error')
    SELECT user_id, event_id, 'queue' AS latency, epoch_us(ts) - epoch_us(signup_at) AS micros FROM c
        WHERE event_type = 'purchase' AND signup_at IS NOT NULL
    UNION ALL SELECT user_id, event_id, 'execution', epoch_us(ts) - epoch_us(view_at) FROM c
        WHERE event_type IN ('error', 'click') AND view_at IS NOT NULL"""


def measured(spark, d):
    return L.latencies(_events(spark, d), LATENCY_SPEC, canceling="error", **_RUN)


@query(LATENCY_SQL)
def latencies(spark, d):
    return measured(spark, d).select("user_id", "event_id", "latency", "micros")


@query(
    f"""SELECT event_id, user_id, attempts, CASE WHEN attempts >= 5 THEN 'FAILED' ELSE 'ACCEPTED' END AS next_state FROM (
        SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER {_UPTO} AS attempts FROM events)
    WHERE event_type = 'error'"""
)
def submission_attempts(spark, d):
    tried = L.submission_attempts(_events(spark, d), "event_type = 'error'", "user_id", _EVENT_ORDER)
    return tried.select("event_id", "user_id", "attempts", "next_state")


DELIVERY = "concat(user_id, '/', date_format(ts, 'yyyy-MM-dd'))"
DELIVERED, ENABLED = "event_type = 'purchase'", "event_type <> 'view' OR value > 20"
DELIVERY_SQL = f"""WITH t AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS delivery_id, ts, event_id,
        ({ENABLED}) AS tried, ({DELIVERED}) AND ({ENABLED}) AS won FROM events),
    n AS (SELECT *, count(*) FILTER (WHERE tried) OVER w AS tries,
        count(*) FILTER (WHERE won OR NOT tried) OVER w AS ends FROM t
        WINDOW w AS (PARTITION BY delivery_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT * FROM n WHERE ends = 0 AND tries < 5)
    SELECT delivery_id, CASE WHEN bool_or(won) THEN 'delivered'
        WHEN bool_or(NOT tried) OR count(*) FILTER (WHERE tried) >= 5 THEN 'failed' ELSE 'pending' END AS status,
        count(*) FILTER (WHERE tried) AS attempts FROM o GROUP BY 1"""


@query(DELIVERY_SQL)
def delivery_outcomes(spark, d):
    tries = _events(spark, d).withColumn("delivery_id", F.expr(DELIVERY))
    return L.delivery_outcomes(tries, DELIVERED, ENABLED, "delivery_id", _EVENT_ORDER)


_CATEGORY = "CASE WHEN value >= 60 THEN 'VALIDATION' WHEN value >= 20 THEN 'WORKLOAD_EXECUTION' END"
_DISPOSITION = "CASE WHEN value >= 80 THEN 'user_action_required' WHEN value >= 40 THEN 'retryable' END"
_PROVIDER = "CASE WHEN value < 50 THEN 'kubernetes' ELSE 'databricks' END"
FAILURE_SQL = f"""WITH cur AS (SELECT user_id, event_type AS state FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    failed AS (SELECT user_id, {_CATEGORY} AS category, {_DISPOSITION} AS disposition, props AS message FROM events
        WHERE event_type = 'error'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    prov AS (SELECT user_id, {_PROVIDER} AS provider FROM events WHERE event_type = 'purchase'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT c.user_id AS run_id, coalesce(category, 'UNKNOWN_RECONCILIATION') AS category,
        coalesce(disposition, 'terminal') AS disposition, coalesce(disposition, 'terminal') = 'retryable' AS retryable,
        coalesce(message, '') AS summary, provider
    FROM cur c LEFT JOIN failed f USING (user_id) LEFT JOIN prov p USING (user_id) WHERE c.state = 'error'"""


def failures(spark, d):
    events = _events(spark, d)
    detailed = events.select(
        "user_id",
        "event_id",
        "ts",
        "event_type",
        F.expr(_CATEGORY).alias("category"),
        F.expr(_DISPOSITION).alias("disposition"),
        F.col("props").alias("message"),
    )
    runs = L.current_state(events, "user_id", "event_type", _EVENT_ORDER)
    providers = events.filter("event_type = 'purchase'").withColumn("provider", F.expr(_PROVIDER))
    return L.run_failure(runs, detailed, providers, "user_id", "state", failed="error", **_RUN)


@query(FAILURE_SQL)
def run_failure(spark, d):
    return failures(spark, d)


_KEY = "CASE WHEN event_type <> 'view' THEN props END"
IDEMPOTENT_SQL = f"""WITH k AS (SELECT event_id, ts, {_KEY} AS key FROM events)
    SELECT event_id, CASE WHEN key IS NULL THEN event_id
        ELSE first_value(event_id) OVER (PARTITION BY key ORDER BY ts, event_id) END AS winner FROM k"""


def submissions(spark, d):
    return _events(spark, d).withColumn("key", F.expr(_KEY))


@query(f"SELECT *, winner = event_id AS created FROM ({IDEMPOTENT_SQL})")
def idempotent_first(spark, d):
    return L.idempotent_first(submissions(spark, d), "key", "event_id", _EVENT_ORDER).select(
        "event_id", "winner", "created"
    )


@query(
    """WITH e AS (SELECT c_custkey AS key, c_name AS label, CAST(-1 AS BIGINT) AS seq FROM customer WHERE c_acctbal < 0),
    n AS (SELECT o_custkey AS key, o_orderpriority AS label, o_orderkey AS seq FROM orders
        WHERE o_custkey NOT IN (SELECT key FROM e) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
    SELECT * FROM e UNION ALL SELECT * FROM n"""
)
def register_if_absent(spark, d):
    existing = table(spark, d, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("label"), F.lit(-1).cast("bigint").alias("seq")
    )
    new = table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("seq")
    )
    return L.register_if_absent(new, existing, ["key"], ["seq"])


@query(
    """WITH e AS (SELECT c_custkey AS key, c_name AS label, CAST(round(c_acctbal * 100) AS BIGINT) AS n FROM customer),
    u AS (SELECT o_custkey * 2 AS key, 'urgent orders' AS label, count(*) AS n FROM orders
        WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT 'table' AS target, e.key, coalesce(u.label, e.label) AS label, coalesce(u.n, e.n) AS n
        FROM e LEFT JOIN u ON e.key = u.key
    UNION ALL SELECT 'error', * FROM u WHERE key NOT IN (SELECT key FROM e)"""
)
def full_replace_upsert(spark, d):
    existing = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("label"), cents("c_acctbal").alias("n")
    )
    new = (
        table(spark, d, "orders")
        .filter("o_orderpriority = '1-URGENT'")
        .groupBy((F.col("o_custkey") * 2).alias("key"))
        .agg(F.lit("urgent orders").alias("label"), F.count(F.lit(1)).alias("n"))
    )
    # the count of urgent orders comes in three versions, of which the last one stays
    versions = new.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("n", F.col("n") - 3 + F.col("step"))
    replaced, errors = L.full_replace_upsert(versions, existing, ["key"], ["step"])
    errors = errors.drop("step")
    return replaced.select(F.lit("table").alias("target"), "*").unionByName(errors.select(F.lit("error").alias("target"), "*"))


# -- queues and listings ----------------------------------------------------------------------------------

_RUN_ORDER = ["o_orderdate", "o_orderkey"]


@query(
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100"""
)
def recent_runs(spark, d):
    recent = L.recent_runs(table(spark, d, "orders"), "1-URGENT", "o_orderpriority", _RUN_ORDER, 100)
    return recent.select("o_orderkey", "o_orderstatus")


_SINCE, _UNTIL = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


@query(
    f"""SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts >= timestamp '{_SINCE}'
    AND ts <= timestamp '{_UNTIL}' ORDER BY ts DESC, event_id DESC LIMIT 100"""
)
def audit_query(spark, d):
    hits = L.audit_query(
        _events(spark, d),
        {"event_type": "error", "user_id": None},
        F.expr(f"timestamp_ntz '{_SINCE}'"),
        F.expr(f"timestamp_ntz '{_UNTIL}'"),
        _EVENT_ORDER,
    )
    return hits.select("event_id", "user_id")


@query(f"SELECT event_id, event_type FROM events WHERE ts >= timestamp '{_SINCE}' AND ts <= timestamp '{_UNTIL}'")
def audit_increment(spark, d):
    since, until = (F.expr(f"timestamp_ntz '{t}'") for t in (_SINCE, _UNTIL))
    return L.audit_query(_events(spark, d), None, since, until, _EVENT_ORDER, limit=None).select("event_id", "event_type")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey")
def runs_by_state(spark, d):
    return L.runs_by_state(table(spark, d, "orders"), ["O", "P"], "o_orderstatus", _RUN_ORDER).select(
        "o_orderkey", "o_orderstatus"
    )


@query(
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'ACCEPTED' ELSE 'SUBMITTING' END AS from_state,
    'SUBMITTING' AS to_state, 'claimed for submission' AS message FROM orders
    WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderdate < timestamp '1998-01-01' - INTERVAL 30 SECOND)"""
)
def claimable_runs(spark, d):
    runs = table(spark, d, "orders").withColumn(
        "state", F.expr("CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'SUBMITTING' ELSE 'RUNNING' END")
    )
    now = F.expr("timestamp_ntz '1998-01-01 00:00:00'")
    return L.claimable_runs(runs, now, run="o_orderkey", updated="o_orderdate", order=_RUN_ORDER)


@query("SELECT c_mktsegment, c_name, c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY 1, 2, 3")
def ordered_listing(spark, d):
    listed = L.listing(table(spark, d, "customer"), ["c_mktsegment", "c_name", "c_custkey"], "c_acctbal > 0")
    return listed.select("c_mktsegment", "c_name", "c_custkey")


# -- joins ------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def enrich_runs(spark, d):
    star = L.enrich(
        table(spark, d, "orders"),
        [
            (table(spark, d, "customer"), {"o_custkey": "c_custkey"}),
            (table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}),
            (table(spark, d, "region"), {"n_regionkey": "r_regionkey"}),
        ],
    )
    return star.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, d):
    return L.orphans(table(spark, d, "documents"), table(spark, d, "labels"), {"doc_id": "doc_id"}).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def in_use(spark, d):
    return L.in_use(table(spark, d, "documents"), table(spark, d, "labels"), {"doc_id": "doc_id"}).select("doc_id", "source")


@query(
    """SELECT 'execution' AS kind, c_name AS name, c_mktsegment AS provider FROM customer
    UNION ALL SELECT 'storage', s_name, CAST(s_nationkey AS VARCHAR) FROM supplier"""
)
def all_providers(spark, d):
    execution = table(spark, d, "customer").withColumnRenamed("c_name", "name")
    storage = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("provider"))
    return L.all_providers(execution, storage, "c_mktsegment")
