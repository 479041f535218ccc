"""Operators over tables that carry the names of the operators' own columns, and names with dots."""

import pytest
from pyspark.sql import functions as F

from concord.operators import lifecycle as L
from concord.operators import reports as R

pytestmark = pytest.mark.usefixtures("interpreted")

OWN = (
    "previous_state consistent attempts next_state winner created status latency micros state entered_at rows r run "
    "category disposition retryable summary n key position class pair a.b event_type le cumulative total"
).split()
HISTORY = [
    (1, "x", 10, None, "ACCEPTED"), (2, "x", 11, "ACCEPTED", "QUEUED"), (3, "x", 12, "QUEUED", "RUNNING"),
    (4, "x", 20, "RUNNING", "FAILED"), (5, "y", 10, None, "ACCEPTED"), (6, "y", 13, "NOWHERE", "QUEUED"), (7, "y", 14, "QUEUED", "QUEUED"),
]


@pytest.fixture
def plain(spark):
    rows = spark.createDataFrame(HISTORY, "id int, run_id string, at int, from_state string, to_state string")
    return rows.withColumn("created_at", F.timestamp_seconds("at")).drop("at")


@pytest.fixture
def clashing(plain):
    return plain.select("*", *[F.lit("clash").alias(name) for name in OWN])


def rows(df, columns):
    return sorted(map(str, df.select(*[F.col(f"`{c}`") for c in columns]).collect()))


@pytest.mark.parametrize("hot_rows", [100, 2])
@pytest.mark.parametrize(
    "operator",
    [
        lambda df, hot: L.transitions(df, stored="from_state", hot_rows=hot),
        lambda df, hot: L.transitions(L.transitions(df, hot_rows=hot), hot_rows=hot),
        lambda df, hot: L.latencies(df, hot_rows=hot),
        lambda df, hot: L.submission_attempts(df, "to_state = 'QUEUED'", hot_rows=hot),
        lambda df, hot: L.idempotent_first(df, "run_id", "from_state", ["created_at", "id"], hot_rows=hot),
        lambda df, hot: L.delivery_outcomes(df, "to_state = 'FAILED'", key="run_id", hot_rows=hot),
        lambda df, hot: L.latest_per_key(df, ["run_id"], ["id"]),
        lambda df, hot: L.current_state(df),
        lambda df, hot: L.latest_event_into_state(df, "QUEUED"),
        lambda df, hot: L.register_if_absent(df.filter("id > 3"), df.filter("id < 3"), ["run_id"], ["id"]),
        lambda df, hot: L.full_replace_upsert(df.filter("id > 3"), df.filter("id < 6"), ["run_id"], ["id"])[0],
        lambda df, hot: L.full_replace_upsert(df.filter("id > 3"), df.filter("id < 3"), ["run_id"], ["id"])[1],
        lambda df, hot: R.terminal_transitions(df),
    ],
)
def test_extra_columns_change_nothing(plain, clashing, operator, hot_rows):
    expected, found = operator(plain, hot_rows), operator(clashing, hot_rows)
    assert len(set(found.columns)) == len(found.columns)
    assert rows(found, expected.columns) == rows(expected, expected.columns)


def test_predicates_see_the_columns_they_were_given(clashing):
    marked = clashing.withColumn("attempts", F.col("id") % 2)
    found = L.submission_attempts(marked, "attempts = 1")
    assert sorted((r["id"], r["attempts"]) for r in found.select("id", "attempts").collect()) == [(1, 1), (3, 2), (5, 1), (7, 2)]
