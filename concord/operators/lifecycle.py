"""Run history: latest row per key, state folding, latencies, retry accounting, queues and listings.

Every operator takes column names, so the same code serves runs, deliveries, definitions and audit rows.
``now`` is always an argument.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concord.functions.canonical import column
from concord.functions.messages import CLAIMED
from concord.functions.state import TERMINAL_STATES
from concord.operators.ordered import HOT_ROWS, First, LastBefore, Previous, RunningSum, scan

MAX_ATTEMPTS = 5
STUCK_GRACE = "30 seconds"


# -- latest, first ----------------------------------------------------------------------------------------


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: str) -> DataFrame:
    chosen = F.expr(f"{pick}(struct(*), struct({', '.join(order)}))").alias("__row")
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(chosen).select("__row.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole newest row per key. Aggregated before the shuffle, so a hot key costs one row per task."""
    return _pick(df, keys, order, "max_by")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, "min_by")


def current_state(
    events: DataFrame, key: str = "run_id", state: str = "to_state", order: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """``key, state``: the state the last event left the run in."""
    at = F.struct(*order)
    return events.groupBy(key).agg(F.max_by(F.col(state), at).alias("state"))


def latest_event_into_state(
    events: DataFrame, to: str, key: str = "run_id", state: str = "to_state", ts: str = "created_at"
) -> DataFrame:
    """``key, entered_at``: when the run last entered state ``to``; runs that never did are absent."""
    return events.filter(F.col(state) == to).groupBy(key).agg(F.max(ts).alias("entered_at"))


def latest_definition(
    definitions: DataFrame,
    version: str | None = None,
    name_col: str = "name",
    version_col: str = "version",
    order: Sequence[str] = ("created_at", "id"),
) -> DataFrame:
    """The newest definition per name by time (never by version text), or exactly ``version``."""
    if version is not None:
        return definitions.filter(F.col(version_col) == version)
    return latest_per_key(definitions, [name_col], order)


# -- ordered history --------------------------------------------------------------------------------------


def transitions(
    events: DataFrame,
    key: str = "run_id",
    state: str = "to_state",
    order: Sequence[str] = ("created_at", "id"),
    stored: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``previous_state`` (in place of a column of that name, as all operators here that add columns do); with ``stored`` also ``consistent``: does the recorded from-state agree?"""
    out = scan(events, [key], order, {"previous_state": Previous(state)}, hot_rows)
    if stored is None:
        return out
    return out.withColumn("consistent", F.col(stored).eqNullSafe(F.col("previous_state")))


LATENCIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "submission": ("ACCEPTED", ("QUEUED",)),
    "queue": ("QUEUED", ("RUNNING",)),
    "execution": ("RUNNING", tuple(sorted(TERMINAL_STATES))),
}


def latencies(
    events: DataFrame,
    spec: Mapping[str, tuple[str, Sequence[str]]] = LATENCIES,
    key: str = "run_id",
    state: str = "to_state",
    order: Sequence[str] = ("created_at", "id"),
    canceling: str = "CANCELING",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``key, id columns, latency, micros``: time from the last start state before an event to the event.

    ``spec`` maps a latency name to (start state, end states). A latency is recorded only when the run was in
    the start state before, the state really changed and the run was not being canceled.
    """
    ts = order[0]
    quoted = lambda text: "'" + text.replace("'", "\\'") + "'"
    scans: dict = {"previous_state": Previous(state)}
    for name, (start, _) in spec.items():
        scans[f"__{name}"] = LastBefore(ts, f"{state} = {quoted(start)}")
    micros = lambda col: F.unix_micros(F.col(col).cast("timestamp"))
    measures = []
    for name, (_, ends) in spec.items():
        value = F.when(F.col(state).isin(*ends), micros(ts) - micros(f"__{name}"))
        measures.append(F.struct(F.lit(name).alias("latency"), value.alias("micros")))
    changed = ~F.col("previous_state").eqNullSafe(F.col(state)) & ~F.col("previous_state").eqNullSafe(F.lit(canceling))
    return (
        scan(events, [key], order, scans, hot_rows)
        .filter(changed)
        .select(key, *order, F.inline(F.array(*measures)))
        .filter(F.col("micros").isNotNull())
    )


def submission_attempts(
    events: DataFrame,
    retryable: str,
    key: str = "run_id",
    order: Sequence[str] = ("created_at", "id"),
    cap: int = MAX_ATTEMPTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Failed submissions with their running number and the state they lead to; the count is never reset.

    ``retryable`` is a SQL predicate that marks a retryable submission failure.
    """
    # the predicate may name columns that the added ones replace
    flagged = events.withColumn("__failed", F.coalesce(F.expr(retryable), F.lit(False)))
    counted = scan(flagged, [key], order, {"attempts": RunningSum("CAST(__failed AS BIGINT)")}, hot_rows)
    return (
        counted.filter("__failed")
        .drop("__failed")
        .withColumn("next_state", F.when(F.col("attempts") >= cap, "FAILED").otherwise("ACCEPTED"))
    )


def delivery_outcomes(
    attempts: DataFrame,
    success: str,
    enabled: str = "true",
    key: str = "delivery_id",
    order: Sequence[str] = ("created_at", "id"),
    cap: int = MAX_ATTEMPTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``key, status, attempts`` after replaying the tries of each delivery.

    ``success`` and ``enabled`` are SQL predicates over a try. A delivered or failed delivery is not tried
    again, so later rows do not count. A missing or disabled subscription fails the delivery without
    counting a try.
    """
    tried = f"coalesce({enabled}, false)"
    won = f"({tried} AND coalesce({success}, false))"
    scans = {
        "__tries": RunningSum(f"CAST({tried} AS BIGINT)"),
        "__ends": RunningSum(f"CAST({won} OR NOT {tried} AS BIGINT)"),
    }
    replayed = scan(attempts, [key], order, scans, hot_rows)
    still_open = f"__ends - CAST({won} OR NOT {tried} AS BIGINT) = 0 AND __tries - CAST({tried} AS BIGINT) < {cap}"
    status = (
        F.when(F.expr(f"bool_or({won})"), "delivered")
        .when(F.expr(f"bool_or(NOT {tried})") | (F.expr(f"count_if({tried})") >= cap), "failed")
        .otherwise("pending")
    )
    return (
        replayed.filter(still_open)
        .groupBy(key)
        .agg(status.alias("status"), F.expr(f"count_if({tried})").alias("attempts"))
    )


# -- failures ---------------------------------------------------------------------------------------------


def failure_defaults(category: Column, disposition: Column, message: Column) -> list[Column]:
    kind = F.coalesce(disposition, F.lit("terminal"))
    return [
        F.coalesce(category, F.lit("UNKNOWN_RECONCILIATION")).alias("category"),
        kind.alias("disposition"),
        (kind == "retryable").alias("retryable"),
        F.coalesce(message, F.lit("")).alias("summary"),
    ]


def run_failure(
    runs: DataFrame,
    events: DataFrame,
    provider_runs: DataFrame,
    run: str = "id",
    run_state: str = "state",
    key: str = "run_id",
    state: str = "to_state",
    order: Sequence[str] = ("created_at", "id"),
    failed: str = "FAILED",
) -> DataFrame:
    """``run_id, category, disposition, retryable, summary, provider`` for failed runs only.

    Details come from the last event into FAILED; a failed run without one gets the defaults and no provider.
    """
    detail = F.struct("category", "disposition", "message")
    last = (
        events.filter(F.col(state) == failed)
        .groupBy(F.col(key).alias("__run"))
        .agg(F.max_by(detail, F.struct(*order)).alias("e"))
    )
    provider = provider_runs.groupBy(F.col(key).alias("__run")).agg(
        F.max_by("provider", F.struct(*order)).alias("provider")
    )
    failures = runs.filter(F.col(run_state) == failed).select(F.col(run).alias("__run"))
    joined = failures.join(last, "__run", "left").join(provider, "__run", "left")
    return joined.select(
        F.col("__run").alias("run_id"),
        *failure_defaults(F.col("e.category"), F.col("e.disposition"), F.col("e.message")),
        F.when(F.col("e").isNotNull(), F.col("provider")).alias("provider"),
    )


# -- idempotency and registration -------------------------------------------------------------------------


def idempotent_first(
    df: DataFrame, key: str, run: str, order: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``winner`` (the first run that used the key) and ``created`` (is this row that run?).

    Rows without a key always create their own run and are not shuffled.
    """
    keyed, unkeyed = df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
    merged = scan(keyed, [key], order, {"winner": First(run)}, hot_rows)
    return merged.unionByName(unkeyed.withColumn("winner", F.col(run))).withColumn(
        "created", F.col("winner").eqNullSafe(F.col(run))
    )


def register_if_absent(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key it lacks; the first such row per key wins."""
    return existing.unionByName(absent_rows(new, existing, keys, order))


def absent_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of ``new`` per key that ``existing`` lacks."""
    taken = existing.select(*[column(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (column(k) == F.col(f"__k{i}"))
    return first_per_key(new.join(taken, same, "left_anti"), keys, order)


def full_replace_upsert(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(replaced table, rows of ``new`` whose key does not exist). A match replaces the whole row.

    Of several new rows with one key the last in ``order`` counts, as if they were applied one after the other.
    """
    keys = list(keys)
    new = latest_per_key(new, keys, order)
    whole = lambda: F.struct(*[column(c) for c in existing.columns])
    packed = new.select(*[column(k).alias(f"__k{i}") for i, k in enumerate(keys)], whole().alias("__new"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (column(k) == F.col(f"__k{i}"))
    merged = existing.join(packed, same, "left")
    replaced = merged.select(F.coalesce(F.col("__new"), whole()).alias("r")).select("r.*")
    taken = existing.select(*[column(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return replaced, new.join(taken, same, "left_anti")


def all_providers(
    execution: DataFrame, storage: DataFrame, execution_provider: str = "provider", storage_provider: str = "provider", name: str = "name"
) -> DataFrame:
    """``kind, name, provider`` of all execution and storage profiles."""
    side = lambda df, kind, provider: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(provider).alias("provider"))
    return side(execution, "execution", execution_provider).unionByName(side(storage, "storage", storage_provider))


# -- queues and listings ----------------------------------------------------------------------------------


def filtered(df: DataFrame, equal: Mapping[str, object] | None = None) -> DataFrame:
    """Equality filters; entries with None are left out."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def newest(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def recent_runs(
    runs: DataFrame,
    environment: str | None = None,
    environment_col: str = "environment_name",
    order: Sequence[str] = ("created_at", "id"),
    limit: int = 100,
) -> DataFrame:
    """Newest runs, optionally of one environment."""
    return newest(filtered(runs, {environment_col: environment}), order, limit)


def audit_query(
    audit: DataFrame,
    equal: Mapping[str, object] | None = None,
    since=None,
    until=None,
    order: Sequence[str] = ("created_at", "id"),
    limit: int | None = 100,
) -> DataFrame:
    """Audit rows by equality and an inclusive time range, newest first; ``limit=None`` gives all of them."""
    hits = filtered(audit, equal)
    if since is not None:
        hits = hits.filter(F.col(order[0]) >= since)
    if until is not None:
        hits = hits.filter(F.col(order[0]) <= until)
    return hits if limit is None else newest(hits, order, limit)


def runs_by_state(
    runs: DataFrame, states: Sequence[str], state: str = "state", order: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """Runs in any of the states, oldest first."""
    return runs.filter(F.col(state).isin(*states)).orderBy(*order)


def claimable_runs(
    runs: DataFrame,
    now: Column,
    grace: str = STUCK_GRACE,
    run: str = "id",
    state: str = "state",
    updated: str = "updated_at",
    order: Sequence[str] = ("created_at", "id"),
) -> DataFrame:
    """Claim events for accepted runs and for runs stuck in SUBMITTING longer than ``grace``, oldest first."""
    cutoff = now - F.expr(f"INTERVAL {grace}")
    stuck = (F.col(state) == "SUBMITTING") & (F.col(updated) < cutoff)
    return (
        runs.filter((F.col(state) == "ACCEPTED") | stuck)
        .orderBy(*order)
        .select(
            F.col(run).alias("run_id"),
            F.col(state).alias("from_state"),
            F.lit("SUBMITTING").alias("to_state"),
            F.lit(CLAIMED).alias("message"),
        )
    )


def listing(df: DataFrame, order: Sequence[str], only: str | None = None) -> DataFrame:
    """Rows in listing order, optionally filtered by a SQL predicate (pending deliveries, enabled subscriptions)."""
    return (df.filter(only) if only else df).orderBy(*order)


# -- joins over the history ------------------------------------------------------------------------------


def enrich(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Star join. Each dimension comes with {fact column: dimension key}; unmatched facts are dropped.

    Dimensions are not hinted: adaptive execution broadcasts those it has measured as small.
    """
    for dimension, on in dimensions:
        condition = F.lit(True)
        for left, right in on.items():
            condition = condition & (fact[left] == dimension[right])
        fact = fact.join(dimension, condition).drop(*[dimension[r] for l, r in on.items()])
    return fact


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose reference points at nothing. A hot reference is split by adaptive execution."""
    return _probe(child, _keys(parent, on), on, "left_anti")


def in_use(parent: DataFrame, child: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Parent rows that a child still refers to (``on`` maps parent to child columns).

    References are made distinct before the join: a parent with a huge number of children costs one row per
    task.
    """
    return _probe(parent, _keys(child, on).distinct(), on, "left_semi")


def _keys(df: DataFrame, on: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(r).alias(f"__{l}") for l, r in on.items()])


def _probe(df: DataFrame, keys: DataFrame, on: Mapping[str, str], how: str) -> DataFrame:
    condition = F.lit(True)
    for left in on:
        condition = condition & (F.col(left) == F.col(f"__{left}"))
    return df.join(keys, condition, how)
