import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from concord.operators import lifecycle as L
from concord.operators.ordered import First, LastBefore, Previous, RunningSum, _sliced, scan

pytestmark = pytest.mark.usefixtures("interpreted")

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


EVENTS = "id bigint, run_id string, to_state string, created_at timestamp, message string, category string, disposition string"


def events(spark, rows):
    """rows: (run, state, second[, message, category, disposition])"""
    full = [(i, r[0], r[1], at(r[2]), *(list(r[3:]) + [None] * (6 - len(r)))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


HAPPY = [("r", s, t) for s, t in (("ACCEPTED", 0), ("SUBMITTING", 5), ("QUEUED", 7), ("RUNNING", 20), ("SUCCEEDED", 80))]


def as_dict(df):
    return {r["latency"]: r["micros"] // 1_000_000 for r in df.collect()}


def test_happy_path(spark):
    log = events(spark, HAPPY)
    assert L.current_state(log).first()["state"] == "SUCCEEDED"
    assert as_dict(L.latencies(log)) == {"submission": 7, "queue": 13, "execution": 60}
    order = [(r["previous_state"], r["to_state"]) for r in L.transitions(log).orderBy("created_at").collect()]
    assert order[0] == (None, "ACCEPTED") and order[-1] == ("RUNNING", "SUCCEEDED")


def test_cancellation_and_self_transitions_record_nothing(spark):
    log = events(spark, [("r", "QUEUED", 0), ("r", "RUNNING", 5), ("r", "RUNNING", 9), ("r", "CANCELING", 10), ("r", "CANCELED", 12)])
    assert as_dict(L.latencies(log)) == {"queue": 5}


def test_latency_uses_the_last_start(spark):
    log = events(spark, [("r", "ACCEPTED", 0), ("r", "SUBMITTING", 1), ("r", "ACCEPTED", 10), ("r", "SUBMITTING", 11), ("r", "QUEUED", 14)])
    assert as_dict(L.latencies(log)) == {"submission": 4}


def test_five_retryable_failures_fail_the_run(spark):
    log = events(spark, [("r", "ACCEPTED", i, "retry") for i in range(6)] + [("q", "ACCEPTED", 1, "retry")])
    rows = L.submission_attempts(log, "message = 'retry'").orderBy("run_id", "created_at").collect()
    states = [(r["run_id"], r["attempts"], r["next_state"]) for r in rows]
    assert states[0] == ("q", 1, "ACCEPTED")
    assert [s[2] for s in states[1:]] == ["ACCEPTED"] * 4 + ["FAILED"] * 2


def outcomes(spark, tries):
    rows = [(i, d, at(i), ok, on) for i, (d, ok, on) in enumerate(tries)]
    df = spark.createDataFrame(rows, "id bigint, delivery_id string, created_at timestamp, ok boolean, enabled boolean")
    return {r["delivery_id"]: (r["status"], r["attempts"]) for r in L.delivery_outcomes(df, "ok", "enabled").collect()}


def test_delivery_outcomes(spark):
    fail, win, off = (False, True), (True, True), (False, False)
    tries = [("ok", *win), ("late", *fail), ("late", *win), ("late", *fail)]
    tries += [("dead", *fail)] * 7 + [("open", *fail)] * 4
    tries += [("off", *fail), ("off", *off), ("off", *win), ("missing", False, None)]
    assert outcomes(spark, tries) == {
        "ok": ("delivered", 1),
        "late": ("delivered", 2),
        "dead": ("failed", 5),
        "open": ("pending", 4),
        "off": ("failed", 1),
        "missing": ("failed", 0),
    }


def test_sixth_try_cannot_deliver(spark):
    assert outcomes(spark, [("d", False, True)] * 5 + [("d", True, True)]) == {"d": ("failed", 5)}


def test_run_failure(spark):
    runs = spark.createDataFrame([("a", "FAILED"), ("b", "FAILED"), ("c", "SUCCEEDED")], "id string, state string")
    log = events(spark, [("a", "FAILED", 1, "old", "VALIDATION", "terminal"), ("a", "FAILED", 2, None, None, "retryable"), ("c", "FAILED", 3)])
    providers = spark.createDataFrame(
        [("a", "kubernetes", at(0), 1), ("a", "databricks", at(1), 2), ("b", "kubernetes", at(0), 3)],
        "run_id string, provider string, created_at timestamp, id bigint",
    )
    rows = {r["run_id"]: r for r in L.run_failure(runs, log, providers).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a["category"], a["disposition"], a["retryable"], a["summary"], a["provider"]) == (
        "UNKNOWN_RECONCILIATION", "retryable", True, "", "databricks",
    )
    assert (b["category"], b["disposition"], b["retryable"], b["provider"]) == ("UNKNOWN_RECONCILIATION", "terminal", False, None)


def test_idempotency(spark):
    rows = [(1, "k", at(5)), (2, "k", at(1)), (3, None, at(0)), (4, None, at(0)), (5, "j", at(0))]
    df = spark.createDataFrame(rows, "run bigint, key string, created_at timestamp")
    winners = {r["run"]: (r["winner"], r["created"]) for r in L.idempotent_first(df, "key", "run", ["created_at", "run"]).collect()}
    assert winners == {1: (2, False), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_register_and_upsert(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 8), ("c", 7)], "k string, v int")
    assert sorted(map(tuple, L.register_if_absent(new, existing, ["k"], ["v"]).collect())) == [("a", 1), ("b", 2), ("c", 7)]
    replaced, errors = L.full_replace_upsert(spark.createDataFrame([("b", 5, 1), ("b", None, 2), ("c", 7, 0), ("c", 8, 1)], "k string, v int, step int"), existing, ["k"], ["step"])
    errors = errors.drop("step")
    assert sorted(map(tuple, replaced.collect())) == [("a", 1), ("b", None)]
    assert list(map(tuple, errors.collect())) == [("c", 8)]


def test_claims(spark):
    rows = [("new", "ACCEPTED", 0), ("stuck", "SUBMITTING", 30), ("edge", "SUBMITTING", 60), ("busy", "RUNNING", 0)]
    df = spark.createDataFrame([(r, s, at(u), at(0)) for r, s, u in rows], "id string, state string, updated_at timestamp, created_at timestamp")
    claimed = L.claimable_runs(df, F.lit(at(90)))
    assert [(r["run_id"], r["from_state"]) for r in claimed.collect()] == [("new", "ACCEPTED"), ("stuck", "SUBMITTING")]


def test_audit_range_is_inclusive(spark):
    df = spark.createDataFrame([(i, at(i), "x" if i % 2 else "y") for i in range(10)], "id int, created_at timestamp, resource string")
    hits = L.audit_query(df, {"resource": None}, F.lit(at(2)), F.lit(at(5)))
    assert [r["id"] for r in hits.collect()] == [5, 4, 3, 2]
    assert [r["id"] for r in L.audit_query(df, {"resource": "x"}, limit=2).collect()] == [9, 7]


def test_joins_over_history(spark):
    child = spark.createDataFrame([("c1", "p1"), ("c2", "p9"), ("c3", "p1"), ("c4", None)], "c string, p string")
    parent = spark.createDataFrame([("p1",), ("p2",)], "id string")
    assert sorted(r["c"] for r in L.orphans(child, parent, {"p": "id"}).collect()) == ["c2", "c4"]
    assert [r["id"] for r in L.in_use(parent, child, {"id": "p"}).collect()] == ["p1"]


# -- hot keys ---------------------------------------------------------------------------------------------

SPECS = {
    "prev": Previous("v"),
    "first": First("v"),
    "last_a": LastBefore("id", "v = 'a'"),
    "total": RunningSum("n"),
}


@pytest.mark.parametrize("shape", ["spread", "burst", "one_time"])
def test_hot_keys_give_the_same_scan(spark, shape):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = None if i % 5 == 0 else ("hot" if i % 3 else f"k{rng.randrange(40)}")
        second = {"spread": rng.randrange(100_000), "burst": rng.choice([0, 1, 2, 99_999]), "one_time": 3}[shape]
        rows.append((key, at(second), i, rng.choice(["a", "b", None]), rng.randrange(-5, 5)))
    df = spark.createDataFrame(rows, "key string, ts timestamp, id bigint, v string, n bigint").repartition(5)
    plain = scan(df, ["key"], ["ts", "id"], SPECS, hot_rows=10**9)
    sliced = scan(df, ["key"], ["ts", "id"], SPECS, hot_rows=50)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))
    # and against the definition
    best = {}
    for key, ts, i, v, n in sorted(rows, key=lambda r: (r[1], r[2])):
        state = best.setdefault(key, {"prev": None, "first": v, "last_a": None, "total": 0, "rows": {}})
        state["total"] += n
        state["rows"][i] = (state["prev"], state["first"], state["last_a"], state["total"])
        state["prev"] = v
        state["last_a"] = i if v == "a" else state["last_a"]
    expected = {i: row for state in best.values() for i, row in state["rows"].items()}
    got = {r["id"]: (r["prev"], r["first"], r["last_a"], r["total"]) for r in sliced.collect()}
    assert got == expected


@pytest.mark.parametrize("shape", ["outlier", "burst", "text ids at one time"])
def test_hot_keys_are_cut_by_rows(spark, shape):
    n, hot = 20_000, 1000
    rows = spark.range(n)
    if shape == "outlier":
        df = rows.selectExpr("'k' AS key", "IF(id = 0, 0, 1700000000 + id) AS ts", "id", "id % 7 AS v")
    elif shape == "burst":
        df = rows.selectExpr("'k' AS key", "IF(id < 100, id * 1000, 5000000) AS ts", "id", "id % 7 AS v")
    else:
        df = rows.selectExpr("'k' AS key", "1 AS ts", "sha2(CAST(id AS STRING), 256) AS id", "id % 7 AS v")
    df = df.unionByName(df.where("v = 1").limit(30).selectExpr("'cold' AS key", "ts", "id", "v"))
    sliced, heavy, by = _sliced(df, ["key"], ["ts", "id"], hot)
    sizes = {r["__slice"]: r["count"] for r in heavy.groupBy("__slice").count().collect()}
    assert sum(sizes.values()) == n and max(sizes.values()) <= 2 * hot
    specs = {"before": Previous("id"), "first": First("id"), "last": LastBefore("id", "v = 3"), "total": RunningSum("v")}
    plain = scan(df, ["key"], ["ts", "id"], specs, hot_rows=10**9)
    cut = scan(df, ["key"], ["ts", "id"], specs, hot_rows=hot)
    assert plain.exceptAll(cut).count() == 0 and cut.count() == n + 30


def test_without_a_hot_key_the_plan_is_a_plain_window(spark):
    df = spark.range(100).selectExpr("id % 9 AS key", "id AS ts", "id")
    plan = scan(df, ["key"], ["ts", "id"], {"before": Previous("id")})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_orders_of_listings(spark):
    from concord.operators import jobs as J

    lines = spark.createDataFrame([("b a b c",), ("c b d",)], "value string")
    assert [tuple(r) for r in J.word_count(lines).collect()] == [("b", 3), ("c", 2), ("a", 1), ("d", 1)]
    rows = [(i, s, at(t)) for i, (s, t) in enumerate([("RUNNING", 5), ("QUEUED", 1), ("FAILED", 0), ("RUNNING", 1), ("QUEUED", 9)])]
    runs = spark.createDataFrame(rows, "id int, state string, created_at timestamp").repartition(4)
    assert [r["id"] for r in L.runs_by_state(runs, ["RUNNING", "QUEUED"]).collect()] == [1, 3, 0, 4]
    assert [r["id"] for r in L.listing(runs, ["state", "id"]).collect()] == [2, 1, 4, 0, 3]
    assert [r["id"] for r in L.newest(runs, ["created_at", "id"], 3).collect()] == [4, 0, 3]
