"""Run states: canonical names, native states of the two execution providers, durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Canonical run states.
STATES = (
    "ACCEPTED",
    "VALIDATING",
    "SUBMITTING",
    "QUEUED",
    "RUNNING",
    "SUCCEEDED",
    "FAILED",
    "CANCELING",
    "CANCELED",
    "UNKNOWN",
    "LOST",
)
TERMINAL_STATES = ("SUCCEEDED", "FAILED", "CANCELED", "LOST")
ACTIVE_STATES = ("SUBMITTING", "QUEUED", "RUNNING")

# Spark operator application states.
OPERATOR_STATES = {
    "Submitted": "SUBMITTING",
    "DriverRequested": "QUEUED",
    "DriverStarted": "QUEUED",
    "DriverReady": "RUNNING",
    "InitializedBelowThresholdExecutors": "RUNNING",
    "RunningWithBelowThresholdExecutors": "RUNNING",
    "RunningWithPartialCapacity": "RUNNING",
    "RunningHealthy": "RUNNING",
    "Succeeded": "SUCCEEDED",
    "Failed": "FAILED",
    "DriverEvicted": "FAILED",
    "DriverReadyTimedOut": "FAILED",
    "DriverStartTimedOut": "FAILED",
    "ExecutorsStartTimedOut": "FAILED",
    "SchedulingFailure": "FAILED",
    "TerminatedWithoutReleaseResources": "FAILED",
    "ScheduledToRestart": "SUBMITTING",
}
# Carries no outcome of its own: the outcome is in the history.
RELEASED = "ResourceReleased"

# Jobs API life cycle and result states.
LIFE_CYCLE_STATES = {
    "PENDING": "QUEUED",
    "QUEUED": "QUEUED",
    "BLOCKED": "QUEUED",
    "WAITING_FOR_RETRY": "QUEUED",
    "RUNNING": "RUNNING",
    "TERMINATING": "RUNNING",
    "INTERNAL_ERROR": "FAILED",
    "SKIPPED": "CANCELED",
}
RESULT_STATES = {
    "SUCCESS": "SUCCEEDED",
    "SUCCESS_WITH_FAILURES": "FAILED",
    "FAILED": "FAILED",
    "TIMEDOUT": "FAILED",
    "UPSTREAM_FAILED": "FAILED",
    "EXCLUDED": "FAILED",
    "DISABLED": "FAILED",
    "MAXIMUM_CONCURRENT_RUNS_REACHED": "FAILED",
    "CANCELED": "CANCELED",
    "UPSTREAM_CANCELED": "CANCELED",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key`` in a fixed table, NULL if absent. A map literal: no join, no shuffle."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*entries)[key]


def last_terminal_outcome(history: Column) -> Column:
    """The newest terminal state in a ``map<string,string>`` history with whole-number keys.

    Keys are compared as numbers. NULL when a key is not a number or no entry is terminal.
    """
    entries = F.transform(
        F.map_entries(history),
        lambda e: F.struct(
            (-F.expr("1L") * e["key"].try_cast("bigint")).alias("age"), e["value"].alias("state")
        ),
    )
    readable = F.forall(F.map_keys(history), lambda k: k.try_cast("bigint").isNotNull())
    terminal = F.filter(
        F.array_sort(entries), lambda e: F.coalesce(lookup(OPERATOR_STATES, e["state"]).isin(*TERMINAL_STATES), F.lit(False))
    )
    return F.when(readable, F.get(terminal, F.lit(0))["state"])


def operator_state(state: Column, history: Column) -> Column:
    """struct(state, native): canonical and native state of a Spark operator application."""
    resolved = F.when(state == RELEASED, F.coalesce(last_terminal_outcome(history), state)).otherwise(state)
    canonical = F.coalesce(lookup(OPERATOR_STATES, resolved), F.lit("UNKNOWN"))
    return F.struct(
        F.when(state.isNull(), "SUBMITTING").otherwise(canonical).alias("state"),
        F.coalesce(resolved, F.lit("Unreported")).alias("native"),
    )


def jobs_state(life_cycle: Column, result: Column, reported: Column | None = None) -> Column:
    """struct(state, native): canonical and native state of a jobs API run.

    The result counts only once the life cycle is TERMINATED. ``reported`` is false where the API returned no
    state at all.
    """
    finished = (life_cycle == "TERMINATED") & result.isNotNull() & (result != "")
    table = F.when(finished, lookup(RESULT_STATES, result)).otherwise(lookup(LIFE_CYCLE_STATES, life_cycle))
    native = F.when(finished, F.concat_ws("/", life_cycle, result)).otherwise(F.coalesce(life_cycle, F.lit("UNKNOWN")))
    if reported is not None:
        native = F.when(reported, native).otherwise("UNREPORTED")
        table = F.when(reported, table)
    return F.struct(F.coalesce(table, F.lit("UNKNOWN")).alias("state"), native.alias("native"))


def event_type(state: Column) -> Column:
    return F.concat(F.lit("run."), F.lower(state))


def format_duration(start: Column, end: Column, now: Column) -> Column:
    """``3m 5s`` or ``5s``; a dash before the start; an open end counts up to ``now``."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    elapsed = (micros(F.coalesce(end, now)) - micros(start)) / 1_000_000
    seconds = F.greatest(F.lit(0), F.floor(elapsed + 0.5).cast("bigint"))
    m, s = F.floor(seconds / 60), seconds % 60
    text = F.when(m > 0, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))
    return F.when(start.isNull(), F.lit("—")).otherwise(text)
