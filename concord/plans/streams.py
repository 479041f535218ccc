"""The streaming jobs, drained over the event file and compared with their batch form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concord.plans import lifecycle as PL
from concord.plans.registry import micros, query, table
from concord.plans.reports import MATCH_SQL, STATES, subscriptions
from concord.streaming import io as I
from concord.streaming import runs as S

_ORDER = ["ts", "event_id"]


def _stream(spark, d) -> DataFrame:
    """The event table as a stream, with timestamps that watermarks accept."""
    schema = table(spark, d, "events").schema
    return I.file_stream(spark, d, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """SELECT user_id, arg_max(event_type, ts) AS state, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
    count(*) AS events FROM events GROUP BY 1"""
)
def stream_fold_run_state(spark, d):
    log = I.epoch_log(S.fold_run_state(_stream(spark, d), "user_id", "event_type", _ORDER), "fold", "update")
    folded = I.newest_epoch(log, ["user_id"])
    return folded.select("user_id", "state", micros("first_at").alias("first_us"), micros("last_at").alias("last_us"), "events")


_STUCK_SECONDS = 1800
_SLOT = _STUCK_SECONDS * 1_000_000
_WATERMARK = f"(SELECT epoch_us(max(ts)) - {3600 * 1_000_000} FROM events)"


@query(
    f"""WITH g AS (SELECT user_id, event_type, epoch_us(ts) AS t,
        epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS n FROM events)
    SELECT user_id, t AS stuck_since_us FROM g
    WHERE event_type = 'error' AND (n IS NULL OR n - t > {_SLOT}) AND t + {_SLOT} <= {_WATERMARK}"""
)
def stream_stuck_runs(spark, d):
    """Alerts for everything the watermark (one hour behind the newest event) has passed."""
    alerts = S.stuck_runs(_stream(spark, d), "1 hour", "user_id", "event_type", _ORDER, "error", _STUCK_SECONDS)
    return I.epoch_log(alerts, "stuck").select("user_id", "stuck_since_us")


@query(
    f"""WITH g AS (SELECT user_id, event_type, epoch_us(ts) AS t,
        epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS n FROM events)
    SELECT user_id, t AS stuck_since_us FROM g WHERE event_type = 'error' AND (n IS NULL OR n - t > {_SLOT})"""
)
def stuck_runs(spark, d):
    """The same over the whole history: open runs behind the watermark included."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stuck = S.stuck_runs(events, "1 hour", "user_id", "event_type", _ORDER, "error", _STUCK_SECONDS)
    return stuck.select("user_id", "stuck_since_us")


@query("SELECT DISTINCT props AS key FROM events")
def stream_dedupe_submissions(spark, d):
    unique = S.dedupe_submissions(_stream(spark, d), "props", "ts", "60 days", "event_id")
    return I.epoch_log(unique.select(F.col("props").alias("key")), "dedupe").select("key")


@query(MATCH_SQL)
def stream_subscription_match(spark, d):
    matched = S.stream_subscription_match(_stream(spark, d), subscriptions(spark).drop("secret"), "event_type", STATES)
    return I.epoch_log(matched.select("event_id", "subscription_id", "event_type"), "match").drop("epoch")


@query(PL.DELIVERY_SQL)
def stream_delivery_retry(spark, d):
    tries = _stream(spark, d).withColumn("delivery_id", F.expr(PL.DELIVERY))
    log = I.epoch_log(
        S.delivery_retry(tries, PL.DELIVERED, PL.ENABLED, "delivery_id", _ORDER), "retry", "update"
    )
    return I.newest_epoch(log, ["delivery_id"])


@query("SELECT event_id, user_id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error'")
def stream_audit_export(spark, d):
    exported = S.audit_export_stream(_stream(spark, d), {"event_type": "error", "user_id": None})
    return I.epoch_log(exported, "audit").select("event_id", "user_id", micros("ts").alias("at_us"))


@query(
    """SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY 1, 2"""
)
def stream_windowed_counters(spark, d):
    counted = S.windowed_counters(_stream(spark, d), "ts", "1 day", ["event_type"], "1 hour")
    log = I.epoch_log(counted, "counters", "update")
    return I.newest_epoch(log, ["window_start", "event_type"]).select(
        micros("window_start").alias("start_us"), "event_type", "events"
    )


@query(
    """WITH w AS (SELECT date_trunc('day', ts) + INTERVAL (h) HOUR AS s, event_type FROM events,
        (SELECT unnest([0, 12]) AS h)
        WHERE ts >= date_trunc('day', ts) + INTERVAL (h) HOUR AND ts < date_trunc('day', ts) + INTERVAL (h) HOUR + INTERVAL 1 DAY
        UNION ALL SELECT date_trunc('day', ts) - INTERVAL 12 HOUR, event_type FROM events
        WHERE ts < date_trunc('day', ts) + INTERVAL 12 HOUR)
    SELECT epoch_us(s) AS start_us, event_type, count(*) AS events FROM w GROUP BY 1, 2"""
)
def stream_sliding_counters(spark, d):
    counted = S.windowed_counters(_stream(spark, d), "ts", "1 day", ["event_type"], "1 hour", "12 hours")
    log = I.epoch_log(counted, "sliding", "update")
    return I.newest_epoch(log, ["window_start", "event_type"]).select(
        micros("window_start").alias("start_us"), "event_type", "events"
    )


@query(f"SELECT * FROM ({PL.LATENCY_SQL}) WHERE event_id IN (SELECT event_id FROM events WHERE epoch_us(ts) <= {_WATERMARK})")
def stream_latency_by_watermark(spark, d):
    """Latencies as a stream: of all events that the watermark has passed."""
    measured = S.latency_stream(_stream(spark, d), "1 hour", PL.LATENCY_SPEC, "user_id", "event_type", _ORDER, "error")
    return I.epoch_log(measured, "latency-stream").select("user_id", "event_id", "latency", "micros")


@query(PL.LATENCY_SQL)
def stream_latency(spark, d):
    measured = S.stream_latency(
        _stream(spark, d), PL.LATENCY_SPEC, "user_id", "event_type", _ORDER, terminal=(), canceling="error"
    )
    return measured.select("user_id", "event_id", "latency", "micros")
