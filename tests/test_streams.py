"""Streams fed in several micro-batches must end where the batch operators end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from concord.operators import lifecycle as L
from concord.session import scratch
from concord.streaming import io as I
from concord.streaming import runs as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, run_id string, to_state string, created_at timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(*events):
    return [(i, run, state, at(t)) for i, (run, state, t) in enumerate(events)]


@pytest.fixture
def feed(spark):
    """Write batches as files, oldest first, and stream them one file per micro-batch."""

    def make(batches, schema=SCHEMA):
        path = scratch(spark, "feed")
        df = None
        for batch in batches:
            df = spark.createDataFrame(batch, schema).coalesce(1)
            df.write.mode("append").parquet(path)
        return I.file_stream(spark, path, df.schema, files_per_trigger=1), spark.read.schema(df.schema).parquet(path)

    return make


LOG = rows(
    ("a", "ACCEPTED", 0), ("b", "ACCEPTED", 1), ("a", "QUEUED", 4),
    ("a", "RUNNING", 10), ("b", "SUBMITTING", 12), ("c", "SUBMITTING", 15),
    ("c", "QUEUED", 60), ("a", "SUCCEEDED", 70), ("b", "QUEUED", 75), ("b", "RUNNING", 90),
    ("d", "SUBMITTING", 95), ("b", "FAILED", 100), ("e", "ACCEPTED", 1000),
)
BATCHES = [LOG[:3], LOG[3:6], LOG[6:10], LOG[10:]]


def test_fold_equals_batch(spark, feed):
    stream, batch = feed(BATCHES)
    folded = I.newest_epoch(I.epoch_log(S.fold_run_state(stream), "fold", "update"), ["run_id"])
    got = {r["run_id"]: (r["state"], r["events"]) for r in folded.collect()}
    assert {k: v[0] for k, v in got.items()} == {r["run_id"]: r["state"] for r in L.current_state(batch).collect()}
    assert got["b"] == ("FAILED", 5)


def test_latency_equals_batch(spark, feed):
    stream, batch = feed(BATCHES)
    columns = ["run_id", "id", "latency", "micros"]
    got = S.stream_latency(stream).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, L.latencies(batch).select(*columns).collect())) and got


def test_latency_stream_equals_batch(spark, feed):
    log = [*LOG, *rows(("a", "RUNNING", 120), ("a", "FAILED", 130), ("a", "SUCCEEDED", 150), ("z", "ACCEPTED", 5000))]
    log = [(i, *r[1:]) for i, r in enumerate(log)]
    # events of a batch out of order, and a run that goes on after its end
    stream, batch = feed([log[3:6] + log[:3][::-1], log[6:10], log[10:13], log[13:]])
    got = I.epoch_log(S.latency_stream(stream, "2 minutes"), "latency-stream").drop("epoch")
    columns = ["run_id", "id", "created_at", "latency", "micros"]
    expected = L.latencies(batch).select(*columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.collect()))
    assert got.where("run_id = 'a' AND latency = 'execution'").count() == 3


def test_latency_after_a_terminal_state(spark, feed):
    log = rows(("a", "ACCEPTED", 0), ("a", "QUEUED", 1), ("a", "RUNNING", 5), ("a", "FAILED", 9), ("a", "SUCCEEDED", 12), ("a", "RUNNING", 14))
    stream, batch = feed([log[:4], log[4:5], log[5:]])
    columns = ["run_id", "id", "latency", "micros"]
    got = S.stream_latency(stream).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, L.latencies(batch).select(*columns).collect()))
    assert sum(r["latency"] == "execution" for r in got) == 2


def test_stuck_runs(spark, feed):
    stream, _ = feed(BATCHES)
    alerts = I.epoch_log(S.stuck_runs(stream, "0 seconds"), "stuck").collect()
    seconds = lambda us: us / 1e6 - T0.replace(tzinfo=dt.timezone.utc).timestamp()
    # c waited 45 s; b waited 63 s; d never moved on; the log's end is far behind the newest event
    assert sorted((r["run_id"], seconds(r["stuck_since_us"])) for r in alerts) == [("b", 12.0), ("c", 15.0), ("d", 95.0)]


def test_edge_of_the_grace_is_not_stuck(spark, feed):
    stream, _ = feed([rows(("x", "SUBMITTING", 0), ("x", "QUEUED", 30), ("y", "SUBMITTING", 1), ("z", "ACCEPTED", 31)), rows(("y", "QUEUED", 32), ("z", "QUEUED", 500))])
    alerts = I.epoch_log(S.stuck_runs(stream, "0 seconds"), "edge").collect()
    assert [r["run_id"] for r in alerts] == ["y"]


def test_stuck_state_is_dropped(spark, feed):
    """Native session windows, whose state falls when the watermark has passed them."""
    batches = [rows(*[(f"{b}-{k}", "SUBMITTING", b * 1000 + k) for k in range(5)]) for b in range(4)]
    stream, batch = feed(batches)
    left = []

    def write(df, epoch):
        df.write.format("noop").mode("overwrite").save()

    query = (
        S.stuck_runs(stream, "0 seconds").writeStream.foreachBatch(write).trigger(availableNow=True)
        .option("checkpointLocation", scratch(spark, "stuck-state")).start()
    )
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(left) <= 10 and left[-1] <= 5
    plan = S.stuck_runs(batch, "0 seconds")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_rows_without_a_key_are_never_merged(spark, feed):
    stream, _ = feed([[(k, None, "ACCEPTED", at(k)) for k in range(5)] + [(9, "a", "ACCEPTED", at(1)), (10, "a", "ACCEPTED", at(2))]])
    kept = I.epoch_log(S.dedupe_submissions(stream, "run_id", "created_at", "1 hour", "id"), "nullkeys").collect()
    assert sorted(r["run_id"] or "" for r in kept) == [""] * 5 + ["a"]


def test_retries_with_text_ids(spark, feed):
    schema = TRY.replace("id bigint", "id string", 1)
    tries = [(f"3f2b-{k}", "d", at(0), k == 2, True) for k in range(4)]
    stream, batch = feed([tries[2:], tries[:2]], schema)
    log = I.epoch_log(S.delivery_retry(stream, "ok", "enabled"), "retry-text", "update")
    got = [tuple(r) for r in I.newest_epoch(log, ["delivery_id"]).select("delivery_id", "status", "attempts").collect()]
    assert got == [("d", "delivered", 3)]


def test_dedupe(spark, feed):
    batches = [[(i, f"k{i % 7}", "ACCEPTED", at(b * 50 + i)) for i in range(50)] for b in range(3)]
    stream, _ = feed(batches)
    kept = I.epoch_log(S.dedupe_submissions(stream, "run_id", "created_at", "1 hour", "id"), "dedupe")
    assert sorted(r["run_id"] for r in kept.collect()) == [f"k{i}" for i in range(7)]


TRY = "id bigint, delivery_id string, created_at timestamp, ok boolean, enabled boolean"


def test_retries_equal_batch(spark, feed):
    tries = [("d1", False, True)] * 3 + [("d2", True, True), ("d3", False, False), ("d1", True, True)] + [("d4", False, True)] * 6
    tries = [(i, d, at(i), ok, on) for i, (d, ok, on) in enumerate(tries)]
    # the second batch arrives out of order
    stream, batch = feed([tries[4:9], tries[:4], tries[9:]], TRY)
    log = I.epoch_log(S.delivery_retry(stream, "ok", "enabled"), "retry", "update")
    got = sorted(map(tuple, I.newest_epoch(log, ["delivery_id"]).select("delivery_id", "status", "attempts").collect()))
    assert got == sorted(map(tuple, L.delivery_outcomes(batch, "ok", "enabled").select("delivery_id", "status", "attempts").collect()))
    assert got == [("d1", "delivered", 4), ("d2", "delivered", 1), ("d3", "failed", 0), ("d4", "failed", 5)]


def state_rows(stream, mode, spark):
    """Rows in the state store after each micro-batch."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: df.write.format("noop").mode("overwrite").save())
        .trigger(availableNow=True).option("checkpointLocation", scratch(spark, "rows")).start()
    )
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_retry_state_has_a_lifetime(spark, feed):
    # deliveries of four hours, ten each; the last batch has a late try that still counts and one that is too late
    tries = [[(b * 100 + k, f"{b}-{k}", at(b * 3600 + k), k % 2 == 0, True) for k in range(10)] for b in range(4)]
    late = [(990, "3-1", at(3 * 3600 - 60), True, True), (991, "0-1", at(60), True, True)]
    stream, batch = feed([*tries, late], TRY)
    retries = lambda: S.delivery_retry(stream, "ok", "enabled", watermark="10 minutes", keep_ms=1_800_000)
    log = I.epoch_log(retries(), "retry-life", "update")
    got = {r["delivery_id"]: (r["status"], r["attempts"]) for r in I.newest_epoch(log, ["delivery_id"]).collect()}
    expected = {
        r["delivery_id"]: (r["status"], r["attempts"]) for r in L.delivery_outcomes(batch.where("id <> 991"), "ok", "enabled").collect()
    }
    assert got == expected and got["3-1"] == ("delivered", 1)
    rows = state_rows(retries(), "update", spark)
    kept = state_rows(S.delivery_retry(stream, "ok", "enabled"), "update", spark)
    assert kept[-1] == 40 and rows[-1] < max(rows)


def test_retries_by_slice(spark, feed):
    """Deliveries of one slice have tries, outcomes and lifetimes of their own; a delivery without an id is one too."""
    ids = [None, *[f"d{k}" for k in range(11)]]
    tries = [(n * 20 + k, d, at(n * 600 + k), (n + k) % 5 == 4, (n + k) % 7 != 6) for n in range(6) for k, d in enumerate(ids)]
    stream, batch = feed([tries[30:50], tries[:30], tries[50:]], TRY)
    log = I.epoch_log(S.delivery_retry(stream, "ok", "enabled", slices=1), "retry-slices", "update")
    got = I.newest_epoch(log, ["delivery_id"]).select("delivery_id", "status", "attempts")
    expected = L.delivery_outcomes(batch, "ok", "enabled").select("delivery_id", "status", "attempts")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect())) and got.count() == 12
    old = [(k, f"old{k}", at(k), False, True) for k in range(5)]
    new = [(100 + n, "old0", at(3600 + n * 1500), False, True) for n in range(2)]
    stream, _ = feed([old, new[:1], new[1:], [(200, "end", at(9000), False, True)], [(201, "end", at(9001), False, True)]], TRY)
    rows = state_rows(S.delivery_retry(stream, "ok", "enabled", watermark="1 second", keep_ms=1_800_000, slices=1), "update", spark)
    assert rows[-1] < rows[0]


@pytest.mark.parametrize("every", [1, 2, 16])
def test_run_states_without_state(spark, feed, every):
    log = [*LOG, (90, "a", "LATE", at(2))]
    stream, batch = feed([LOG[:3], LOG[3:6], LOG[6:10], LOG[10:], [log[-1]]])
    got = S.run_state_table(stream, compact_every=every)
    expected = S.fold_run_state(batch)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert {r["run_id"]: (r["state"], r["events"]) for r in got.collect()}["a"] == ("SUCCEEDED", 5)


def test_run_states_of_no_events(spark, feed):
    stream, _ = feed([[]])
    assert S.run_state_table(stream).collect() == []


def test_windows_and_export(spark, feed):
    stream, batch = feed(BATCHES)
    counted = I.newest_epoch(
        I.epoch_log(S.windowed_counters(stream, "created_at", "1 minute", ["to_state"], "1 day"), "w", "update"),
        ["window_start", "to_state"],
    )
    expected = batch.groupBy(F.window("created_at", "1 minute").start.alias("window_start"), "to_state").count()
    assert sorted(map(str, counted.select("window_start", "to_state", F.col("events").alias("count")).collect())) == sorted(map(str, expected.collect()))
    exported = I.epoch_log(S.audit_export_stream(stream, {"to_state": "QUEUED", "run_id": None}), "x")
    assert sorted(r["run_id"] for r in exported.collect()) == ["a", "b", "c"]


def test_subscription_match(spark, feed):
    stream, _ = feed(BATCHES)
    subs = spark.createDataFrame([("s", ["run.failed"], True), ("w", ["run.state_changed"], True)], "subscription_id string, event_types array<string>, enabled boolean")
    matched = I.epoch_log(S.stream_subscription_match(stream, subs), "m")
    counts = {r["subscription_id"]: r["count"] for r in matched.groupBy("subscription_id").count().collect()}
    assert counts == {"s": 1, "w": len(LOG)}
