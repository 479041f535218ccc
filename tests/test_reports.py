import hashlib
import hmac
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.operators import events as E
from concord.operators import reports as R

pytestmark = pytest.mark.usefixtures("interpreted")


def certification(spark, environments, execution, storage, worst=False):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    report = R.certification_report(
        df(environments, "name string, execution_profile_name string, storage_profile_name string"),
        df(execution, "name string, provider string, spark_versions array<string>"),
        df(storage, "name string, provider string, config string"),
        df([("kubernetes", "s3"), ("databricks", "s3")], "execution_provider string, storage_protocol string"),
        worst,
    )
    return {(r["execution_provider"], r["storage_protocol"]): (r["status"], r["detail"]) for r in report.collect()}


def test_fifty_environments_are_one_pair(spark):
    n = range(50)
    rows = certification(
        spark,
        [(f"env-{i}", f"exec-{i}", f"storage-{i}") for i in n],
        [(f"exec-{i}", "kubernetes", ["4.1"]) for i in n],
        [(f"storage-{i}", "s3", "{}") for i in n],
    )
    assert rows == {("kubernetes", "s3"): ("PASS", None)}


def test_evidence_does_not_compose(spark):
    rows = certification(spark, [("e", "x", "v")], [("x", "databricks", ["4.1"])], [("v", "vast", "{}")])
    assert rows[("databricks", "vast-s3")][0] == "BLOCKED"


def test_first_environment_decides_unless_worst(spark):
    envs = [("a", "good", "s"), ("b", "bad", "s")]
    execution = [("good", "kubernetes", ["4.1"]), ("bad", "kubernetes", [])]
    assert certification(spark, envs, execution, [("s", "s3", "{}")])[("kubernetes", "s3")][0] == "PASS"
    assert certification(spark, envs, execution, [("s", "s3", "{}")], True)[("kubernetes", "s3")][0] == "FAIL"
    swapped = [("a", "bad", "s"), ("b", "good", "s")]
    assert certification(spark, swapped, execution, [("s", "s3", "{}")])[("kubernetes", "s3")][0] == "FAIL"


OUTPUTS = "name string, version string, definition struct<outputs:array<struct<name:string,dataset:string>>>"


def legs(spark, requested, runs, outputs, bindings, output=None):
    df = spark.createDataFrame
    return R.resolve_legs(
        df(list(enumerate(requested)), "position int, run_id string"),
        df(runs, "id string, workload_name string, workload_version string, environment_name string, state string"),
        df([("w", "1", (outputs,))], OUTPUTS),
        df(bindings, "dataset_name string, environment_name string, kind string, uri string"),
        output,
    )


def reasons(df):
    return [r["reason"] for r in df.orderBy("position").collect()]


def test_legs(spark):
    runs = [("a", "w", "1", "env-a", "SUCCEEDED"), ("b", "w", "1", "env-b", "RUNNING"), ("c", "w", "1", "env-c", "SUCCEEDED")]
    bound = [("out", "env-a", "path", "s3a://a"), ("other", "env-a", "path", "s3a://o")]
    outputs = [("z", "out"), ("a", "other")]
    got = legs(spark, ["a", "b", "c", "nope"], runs, outputs, bound)
    assert reasons(got) == [None, "run not SUCCEEDED (state=RUNNING)", "no dataset binding for 'out' in 'env-c'", "run 'nope' not found"]
    assert got.filter("position = 0").first()["uri"] == "s3a://a"
    assert legs(spark, ["a"], runs, outputs, bound, "a").first()["uri"] == "s3a://o"
    assert reasons(legs(spark, ["a"], runs, outputs, bound, "x")) == ["workload has no output named 'x'"]
    assert reasons(legs(spark, ["a"], runs, [], bound)) == ["workload declares no output datasets"]


def test_pairs(spark):
    data = {"u1": spark.range(3), "u2": spark.range(3).repartition(3), "u3": spark.range(4), "u4": spark.range(3).select(F.col("id").cast("int"))}
    names = list(data)
    runs = [(n, "w", "1", f"env-{n}", "SUCCEEDED") for n in names] + [("bad", "w", "1", "env-bad", "FAILED")]
    bound = [("out", f"env-{n}", "path", n) for n in names]
    requested = [*names, "bad"]
    ready = legs(spark, requested, runs, [("o", "out")], bound)
    profiles = R.profile_locations(spark, ready, lambda kind, uri: data[uri])
    report = {
        (r["left_environment"][4:], r["right_environment"][4:]): (r["status"], list(r["mismatches"]))
        for r in R.compare_runs(ready, R.run_pairs(spark, requested), profiles).collect()
    }
    assert len(report) == 10
    assert report[("u1", "u2")] == ("PASS", [])
    assert report[("u1", "u3")][0] == "FAIL" and report[("u1", "u3")][1][0].startswith("row count mismatch: left=3 right=4")
    assert report[("u1", "u4")][1][0].startswith("schema mismatch") and len(report[("u1", "u4")][1]) == 1
    assert report[("u1", "bad")] == ("BLOCKED", ["run not SUCCEEDED (state=FAILED)"])
    classes = R.equivalence_classes(ready.join(profiles, ["kind", "uri"]), ["run_id"]).collect()
    assert {r["run_id"]: (r["class"]["run_id"], r["members"]) for r in classes} == {
        "u1": ("u1", 2), "u2": ("u1", 2), "u3": ("u3", 1), "u4": ("u4", 1),
    }


def test_pairs_of_any_number_of_runs(spark):
    from itertools import combinations

    for n in (0, 1, 2, 5, 300):
        rows = R.run_pairs(spark, [str(i) for i in range(n)]).orderBy("pair").collect()
        assert [tuple(r) for r in rows] == [(i, a, b) for i, (a, b) in enumerate(combinations(range(n), 2))]


def test_three_hundred_legs(spark, monkeypatch):
    monkeypatch.setattr(R, "LOCATIONS_PER_PLAN", 3)
    data = {f"place{k}": spark.createDataFrame([(k % 2, 1.5)], "a int, b double") for k in range(7)}
    ids = [f"run{k}" for k in range(300)]
    runs = [(i, "w", "1", f"env{k % 7}", "SUCCEEDED" if k % 10 else "FAILED") for k, i in enumerate(ids)]
    bound = [("out", f"env{k}", "path", f"place{k}") for k in range(7)]
    ready = legs(spark, ids, runs, [("o", "out")], bound)
    profiles = R.profile_locations(spark, ready, lambda kind, uri: data[uri])
    assert profiles.count() == 7
    report = R.compare_runs(ready, R.run_pairs(spark, ids), profiles).groupBy("status").count().collect()
    good = [k for k in range(300) if k % 10]
    same = sum((a % 7 % 2) == (b % 7 % 2) for a in good for b in good if a < b)
    assert {r["status"]: r["count"] for r in report} == {
        "PASS": same, "FAIL": len(good) * (len(good) - 1) // 2 - same, "BLOCKED": 300 * 299 // 2 - len(good) * (len(good) - 1) // 2
    }


def test_requested_ids_reduce_the_history(spark):
    many = spark.range(1_000_000).selectExpr(
        "CAST(id AS STRING) AS id", "'w' AS workload_name", "'1' AS workload_version", "'e' AS environment_name", "'SUCCEEDED' AS state"
    )
    requested = spark.createDataFrame(pa.table({"position": [0], "run_id": ["17"]}))
    definitions = spark.createDataFrame([], "name string, version string, definition struct<outputs:array<struct<name:string,dataset:string>>>")
    bindings = spark.createDataFrame([], "dataset_name string, environment_name string, kind string, uri string")
    found = R.resolve_legs(requested, many, definitions, bindings)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert found.first()["reason"] == "workload declares no output datasets"


def test_failed_check_is_the_reason(spark):
    environments = spark.createDataFrame([("e", "x", "s")], "name string, execution_profile_name string, storage_profile_name string")
    execution = spark.createDataFrame([("x", "k8s", ["4.1"], "timeout")], "name string, provider string, spark_versions array<string>, check_error string")
    storage = spark.createDataFrame([("s", "s3", "{}")], "name string, provider string, config string")
    evidence = spark.createDataFrame([("k8s", "s3")], "execution_provider string, storage_protocol string")
    row = R.certification_report(environments, execution, storage, evidence).first()
    assert (row["status"], row["detail"]) == ("FAIL", "timeout")


def test_legs_without_environment_have_a_reason(spark):
    row = legs(spark, ["r"], [("r", "w", "1", None, "SUCCEEDED")], [("o", "out")], [("out", "e", "path", "u")]).first()
    assert row["reason"] == "no dataset binding for 'out' in 'NULL'" and row["uri"] is None


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("q", v) for v in (1, 5, 5, 20)], "latency string, micros bigint")
    rows = {r["le"]: (r["cumulative"], r["count"], r["total"]) for r in R.latency_histogram(df, [1, 5, 10]).collect()}
    assert rows == {"1": (1, 4, 31), "5": (3, 4, 31), "10": (3, 4, 31), "+Inf": (4, 4, 31)}


def test_portability_rate(spark):
    rows = [("a", "k", 0), ("a", "d", 0), ("b", "k", 0), ("c", "k", 0), ("c", "d", 2)]
    rate = R.portability_rate(spark.createDataFrame(rows, "workload string, provider string, overrides int")).first()
    assert (rate["workloads"], rate["portable"]) == (3, 1)


def test_unhandled_errors_count_as_500(spark):
    rows = [("GET", "/a", 200), ("GET", "/a", 404), ("GET", "/a", None), ("GET", "/a", None)]
    found = R.api_errors(spark.createDataFrame(rows, "method string, route string, status_code int")).collect()
    assert {r["status_code"]: r["errors"] for r in found} == {404: 1, 500: 2}


SUBSCRIPTION = "subscription_id string, event_types array<string>, secret string, enabled boolean"


def test_subscriptions(spark):
    subs = spark.createDataFrame(
        [("one", ["run.failed"], "s", True), ("all", ["run.state_changed", "run.failed"], "s", True), ("off", ["run.state_changed"], "s", False)],
        SUBSCRIPTION,
    )
    rows = [(1, None, "ACCEPTED", "run accepted"), (2, "ACCEPTED", "SUBMITTING", "claimed for submission"), (3, "RUNNING", "RUNNING", "transient"), (4, "RUNNING", "FAILED", None)]
    log = spark.createDataFrame(rows, "id int, from_state string, to_state string, message string")
    matched = E.match_subscriptions(log, subs, message="message", from_state="from_state")
    assert sorted((r["id"], r["subscription_id"]) for r in matched.collect()) == [(3, "all"), (4, "all"), (4, "one")]


@pytest.mark.parametrize("secret", ["k", "secret ü", "x" * 64, "y" * 65, "z" * 200])
def test_signature_is_hmac_sha256(spark, secret):
    payloads = ["", "{}", '{"a":"ü"}', "p" * 300]
    subs = spark.createDataFrame([("s", secret)], "subscription_id string, secret string")
    deliveries = spark.createDataFrame([("s", p) for p in payloads], "subscription_id string, payload string")
    signed = E.signed_deliveries(deliveries, subs)
    assert "secret" not in signed.columns
    for r in signed.collect():
        assert r["signature"] == hmac.new(secret.encode(), r["payload"].encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("text", ["", "plain", 'say "x" \\ /', "line\nfeed\ttab\r\f\b", "Ünï €", "\U0001f600 x", "\x00\x1f\x7f\x80", None])
def test_json_text(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(E.json_text(F.col("t")).alias("j")).first()["j"]
    assert found == json.dumps(text)


def test_wildcard_hears_states_outside_the_list(spark):
    subs = spark.createDataFrame(
        [("all", ["run.state_changed"], "s", True), ("one", ["run.paused", None], "s", True), ("other", ["run.resumed"], "s", True)],
        SUBSCRIPTION,
    )
    log = spark.createDataFrame([(1, "PAUSED"), (2, "FAILED")], "id int, to_state string")
    matched = E.match_subscriptions(log, subs).select("id", "subscription_id", "event_type").collect()
    assert sorted(map(tuple, matched)) == [(1, "all", "run.paused"), (1, "one", "run.paused"), (2, "all", "run.failed")]


def test_a_frequent_type_is_dealt_out(spark):
    subs = spark.range(60).selectExpr(
        "CONCAT('s', id) AS subscription_id",
        "CASE WHEN id % 3 = 0 THEN array('run.state_changed') WHEN id % 3 = 1 THEN array('run.failed') ELSE array('run.odd', 'run.queued') END AS event_types",
        "'k' AS secret", "id % 7 > 0 AS enabled",
    )
    log = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN 'FAILED' WHEN id % 20 = 0 THEN 'QUEUED' ELSE 'ODD' END AS to_state")
    plain, dealt = (E.match_subscriptions(log, subs, pieces=p) for p in (None, 64))
    assert dealt.columns == plain.columns
    difference = plain.exceptAll(dealt).unionByName(dealt.exceptAll(plain))
    assert difference.count() == 0 and dealt.count() == plain.count() > 0
    # joined on event type alone nine of ten events meet in one task
    typed = log.withColumn("event_type", F.concat(F.lit("run."), F.lower("to_state")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        def largest(pieces):
            heard = E.heard_by(typed, E.subscription_index(subs), pieces=pieces).select("id", F.spark_partition_id().alias("task")).distinct()
            sizes = [r["count"] for r in heard.groupBy("task").count().collect()]
            return max(sizes) / (sum(sizes) / 8)

        assert largest(None) > 5 and largest(512) < 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_payload(spark):
    import datetime as dt

    df = spark.createDataFrame([("r", None, 'say "x"', dt.datetime(2024, 1, 1, 0, 0, 1, 20))], "run string, f string, m string, at timestamp")
    c, lit = F.col, F.lit
    text = df.select(E.event_payload(c("run"), lit("w"), lit("1"), lit("e"), c("f"), lit("FAILED"), c("m"), c("at")).alias("p")).first()["p"]
    assert text == json.dumps(json.loads(text))
    assert json.loads(text) == {
        "run_id": "r", "workload_name": "w", "workload_version": "1", "environment_name": "e",
        "from_state": None, "to_state": "FAILED", "message": 'say "x"', "timestamp": "2024-01-01T00:00:01.000020+00:00",
    }
