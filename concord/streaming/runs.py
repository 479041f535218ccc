"""Run events, deliveries and audit rows as streams.

Hot keys: state folding and counters aggregate before the shuffle; duplicates are thinned per salt first; stuck-run
detection keeps one session per run; latencies run the batch operator on each micro-batch,
which slices hot runs. Only delivery retries are folded row by row, and a delivery has at most five tries; deliveries are
processed by slices of a hash, many to a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from concord.functions.state import STATES, event_type
from concord.operators.events import heard_by, subscription_index
from concord.operators.lifecycle import LATENCIES, MAX_ATTEMPTS, latencies
from concord.session import scratch
from concord.streaming.io import run_available


def fold_run_state(
    events: DataFrame, key: str = "run_id", state: str = "to_state", order: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """``key, state, first_at, last_at, events``; update mode.

    A streaming aggregate keeps one small buffer per run and combines rows before the shuffle, so neither a
    hot run nor late events need special care. State grows with the number of runs and is never dropped, as any run
    may move again; :func:`run_state_table` keeps none.
    """
    ts = order[0]
    return events.groupBy(key).agg(
        F.max_by(F.col(state), F.struct(*order)).alias("state"),
        F.min(ts).alias("first_at"),
        F.max(ts).alias("last_at"),
        F.count(F.lit(1)).alias("events"),
    )


COMPACT_EVERY = 16


def run_state_table(
    events: DataFrame,
    key: str = "run_id",
    state: str = "to_state",
    order: Sequence[str] = ("created_at", "id"),
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Drain the stream and return :func:`fold_run_state` of all its events as a table: ``key, state, first_at, last_at, events``.

    No run is held in the stream's state. Each micro-batch hands its own fold, a row per run that it has events of, to
    a table, and folds of one run add up whatever their order, so late events and runs that move again need nothing special.
    Every ``compact_every`` batches the folds so far are added up and written as one; a repeated batch writes what it wrote
    the first time.
    """
    spark: SparkSession = events.sparkSession
    root = scratch(spark, "run-state")
    columns = [key, *order, state]
    at = T.StructType([T.StructField(c, events.schema[c].dataType) for c in order])
    schema = T.StructType(
        [
            events.schema[key],
            T.StructField("state", events.schema[state].dataType),
            T.StructField("at", at),
            T.StructField("first_at", events.schema[order[0]].dataType),
            T.StructField("events", T.LongType()),
        ]
    )

    def since(session: SparkSession, epoch: int, base: int) -> DataFrame:
        """The folds up to ``epoch``: those added up before ``base`` and one of each batch from there on."""
        paths = [f"{root}/folds/epoch={k}" for k in range(base, epoch + 1)]
        return session.read.schema(schema).parquet(*([f"{root}/base={base}"] if base else []), *paths)

    def process(batch: DataFrame, epoch: int) -> None:
        mine = batch.groupBy(key).agg(
            F.max_by(F.col(state), F.struct(*order)).alias("state"),
            F.max(F.struct(*order)).alias("at"),
            F.min(order[0]).alias("first_at"),
            F.count(F.lit(1)).alias("events"),
        )
        mine.write.mode("overwrite").parquet(f"{root}/folds/epoch={epoch}")
        last[0] = epoch
        if (epoch + 1) % compact_every == 0:
            base = epoch + 1
            _added(since(batch.sparkSession, epoch, base - compact_every), key).write.mode("overwrite").parquet(f"{root}/base={base}")

    last = [-1]
    run_available(events.select(*columns), f"{root}/checkpoint", process)
    if last[0] < 0:
        folds = spark.createDataFrame([], schema)
    else:
        base = (last[0] + 1) // compact_every * compact_every
        folds = spark.read.schema(schema).parquet(f"{root}/base={base}") if base > last[0] else since(spark, last[0], base)
    return _added(folds, key).select(key, "state", "first_at", F.col(f"at.{order[0]}").alias("last_at"), "events")


def _added(folds: DataFrame, key: str) -> DataFrame:
    """Folds of one run as one."""
    return folds.groupBy(key).agg(
        F.max_by("state", "at").alias("state"),
        F.max("at").alias("at"),
        F.min("first_at").alias("first_at"),
        F.sum("events").alias("events"),
    )


def dedupe_submissions(
    submissions: DataFrame, key: str, ts: str, watermark: str, spread_by: str, salts: int = 32
) -> DataFrame:
    """At most one row per key within the watermark; rows without a key are never merged; append mode.

    The first pass drops duplicates per (key, salt), the salt taken from ``spread_by`` (a row id), so a hot
    key is spread over ``salts`` tasks and at most ``salts`` of its rows reach the second, exact pass.
    """
    marked = submissions.withWatermark(ts, watermark)
    salted = marked.where(F.col(key).isNotNull()).withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    keyed = salted.dropDuplicatesWithinWatermark([key, "__salt"]).dropDuplicatesWithinWatermark([key]).drop("__salt")
    return keyed.unionByName(marked.where(F.col(key).isNull()))


def stream_subscription_match(
    events: DataFrame,
    subscriptions: DataFrame,
    state: str = "to_state",
    states: Sequence[str] = STATES,
    pieces: int | None = None,
    shares: DataFrame | None = None,
) -> DataFrame:
    """One delivery per event and matching subscription; append mode, stateless.

    ``pieces`` with ``shares``, the counts of an earlier time (:func:`~concord.operators.events.type_shares`), deal frequent
    types out where the subscriptions are too many to be broadcast.
    """
    if pieces is not None and shares is None:
        raise ValueError("a stream cannot be counted first: give the shares of an earlier time")
    typed = events.withColumn("event_type", event_type(F.col(state)))
    return heard_by(typed, subscription_index(subscriptions, states), states, pieces, shares)


def audit_export_stream(audit: DataFrame, equal: Mapping[str, object] | None = None) -> DataFrame:
    """Filtered audit rows for an outside system. Exactly once together with a file sink or an epoch log."""
    for name, value in (equal or {}).items():
        if value is not None:
            audit = audit.filter(F.col(name) == value)
    return audit


def windowed_counters(
    events: DataFrame, ts: str, width: str, by: Sequence[str], watermark: str, slide: str | None = None
) -> DataFrame:
    """``window_start, window_end, by, events`` per tumbling or sliding window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.withWatermark(ts, watermark).groupBy(window, *by).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "events")


# -- stuck runs -------------------------------------------------------------------------------------------


def stuck_runs(
    events: DataFrame,
    watermark: str,
    key: str = "run_id",
    state: str = "to_state",
    order: Sequence[str] = ("created_at", "id"),
    watched: str = "SUBMITTING",
    grace_seconds: int = 30,
) -> DataFrame:
    """``key, stuck_since_us``: runs that stayed in ``watched`` longer than the grace; append mode.

    A run's events that are no further apart than the grace form one session, so a session that ends in ``watched`` is
    an alert. It is reported when the watermark has passed the end of its grace, and its state is dropped then. Events
    later than the watermark are dropped.
    """
    ts = order[0]
    sessions = (
        events.withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, f"{grace_seconds} seconds").alias("session"), key)
        .agg(F.max(ts).alias("last_at"), F.max_by(F.col(state), F.struct(*order)).alias("last_state"))
    )
    return sessions.where(F.col("last_state") == watched).select(key, F.unix_micros("last_at").alias("stuck_since_us"))


# -- delivery retries -------------------------------------------------------------------------------------


class _RetryProcessor(StatefulProcessor):
    """Per slice of the deliveries: the earliest tries of each one, as many as count.

    A slice is a group of Spark's, so what a group costs (its messages to the state store, a batch of output) is shared by
    all its deliveries; each of them has an entry of its own in the slice's map.
    """

    def __init__(self, key: str, schema: str, cap: int, tie: str, keep_ms: int | None):
        self.key, self.schema, self.cap, self.tie, self.keep_ms = key, schema, cap, tie, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = f"tries array<struct<at_us:bigint,tie:{self.tie},won:boolean,tried:boolean>>, due bigint"
        self.known = handle.getMapState("tries", self.schema, value)
        self.swept: set = set()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # only the earliest tries can matter, whatever order they arrive in: memory is ``cap`` rows a delivery
        arrived: dict = {}
        for r in rows:
            id_ = r[self.key]
            name = id_ if id_ is None or isinstance(id_, str | int | bytes) else repr(id_)
            entry = arrived.setdefault(name, [id_, r["at_us"], []])
            entry[1] = max(entry[1], r["at_us"])
            entry[2].append((r["at_us"], r["tie"], r["won"], r["tried"]))
            if len(entry[2]) >= 4 * self.cap:
                entry[2] = self._earliest(entry[2])
        old, timers = self.known.exists(), set()
        for id_, latest, tries in arrived.values():
            seen, due = (old and self.known.getValue((id_,))) or ((), None)
            kept = self._earliest([*map(tuple, seen), *tries])
            if self.keep_ms is not None:
                due = max(due or 0, -(-latest // 1000) + self.keep_ms)
                timers.add(due)
            self.known.updateValue((id_,), (kept, due))
            status, attempts = self._outcome(kept)
            yield Row(**{self.key: id_, "status": status, "attempts": attempts})
        for due in timers:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Deliveries whose time is over leave the slice, all at its first timer; one that was tried since has a later timer."""
        now, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        if key not in self.swept or now >= watermark:
            over = [id_ for id_, (_, due) in self.known.iterator() if due < watermark or due <= now]
            for id_ in over:
                self.known.removeKey(id_)
            self.swept.add(key)
        return iter(())

    def _earliest(self, tries: list[tuple]) -> list[tuple]:
        return heapq.nsmallest(self.cap, tries, key=lambda t: (t[0], t[1]))

    def _outcome(self, tries: Sequence[tuple]) -> tuple[str, int]:
        for attempts, (_, _, won, tried) in enumerate(tries):
            if not tried:
                return "failed", attempts
            if won:
                return "delivered", attempts + 1
        return ("failed" if len(tries) >= self.cap else "pending"), len(tries)

    def close(self) -> None:
        pass


#: Groups that the deliveries of a stream are dealt out to: many for any number of tasks, few beside the deliveries.
SLICES = 1 << 14


def delivery_retry(
    tries: DataFrame,
    success: str,
    enabled: str = "true",
    key: str = "delivery_id",
    order: Sequence[str] = ("created_at", "id"),
    cap: int = MAX_ATTEMPTS,
    watermark: str | None = None,
    keep_ms: int | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """``key, status, attempts`` whenever a delivery is tried; update mode. Memory per key is ``cap`` tries.

    Deliveries are processed by ``slices`` of a hash, since a group costs much more than a delivery in it. The number must
    stay the same as long as a checkpoint is used.

    The tie column keeps its type, so text ids order as text. With ``keep_ms`` (and a ``watermark``) a delivery's state
    falls when the watermark is so far behind its latest try; a try after that is the first of a new delivery, and one later
    than the watermark is dropped. Without it state stays as long as the stream lives.
    """
    if (keep_ms is None) != (watermark is None):
        raise ValueError("state has a lifetime by event time: give both watermark and keep_ms, or neither")
    if watermark is not None:
        tries = tries.withWatermark(order[0], watermark)
    rows = tries.select(
        key,
        F.pmod(F.xxhash64(key), F.lit(slices)).alias("__slice"),
        *([] if watermark is None else [order[0]]),
        F.unix_micros(F.col(order[0]).cast("timestamp")).alias("at_us"),
        F.col(order[1]).alias("tie"),
        F.expr(f"coalesce({enabled}, false) AND coalesce({success}, false)").alias("won"),
        F.expr(f"coalesce({enabled}, false)").alias("tried"),
    )
    kinds = [tries.schema[c].dataType.simpleString() for c in (key, order[1])]
    return rows.groupBy("__slice").transformWithState(
        statefulProcessor=_RetryProcessor(key, f"`{key}` {kinds[0]}", cap, kinds[1], keep_ms),
        outputStructType=T.StructType(
            [tries.schema[key], T.StructField("status", T.StringType()), T.StructField("attempts", T.LongType())]
        ),
        outputMode="Update",
        timeMode="None" if keep_ms is None else "EventTime",
    )


# -- latencies --------------------------------------------------------------------------------------------


class _LatencyProcessor(StatefulProcessor):
    """Per run: events the watermark has not passed yet, the last state it has, and when each start state was entered."""

    def __init__(self, key: str, tie: str, spec: Mapping[str, tuple[str, Sequence[str]]], canceling: str, keep_ms: int | None):
        self.key, self.tie, self.canceling, self.keep_ms = key, tie, canceling, keep_ms
        self.spec = {name: (start, frozenset(ends)) for name, (start, ends) in spec.items()}
        self.starts = {start for start, _ in self.spec.values()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at_us bigint, tie {self.tie}, state string")
        self.known = handle.getValueState("known", "state string, entered map<string,bigint>, due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = [(r["at_us"], r["tie"], r["state"]) for r in rows]
        self.waiting.appendList(arrived)
        state, entered, due = self.known.get() or (None, {}, None)
        self._await(state, entered, due, self._due(min(r[0] for r in arrived)), waits=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        state, entered, _ = self.known.get()
        entered = dict(entered)
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        ready = [e for e in events if self._due(e[0]) <= watermark]
        if not events:
            self.known.clear()  # nothing has happened for as long as the run is kept
            return
        for at_us, tie, now in ready:
            if now != state and state != self.canceling:
                for name, (start, ends) in self.spec.items():
                    if now in ends and start in entered:
                        yield Row(**{self.key: key[0], "at_us": at_us, "tie": tie, "latency": name, "micros": at_us - entered[start]})
            if now in self.starts:
                entered[now] = at_us
            state = now
        rest = events[len(ready) :]
        self.waiting.clear()
        if rest:
            self.waiting.put([tuple(e) for e in rest])
            self._await(state, entered, None, self._due(rest[0][0]), waits=True)
        else:
            due = None if self.keep_ms is None else self._due(ready[-1][0]) + self.keep_ms
            self._await(state, entered, None, due, waits=False)

    def _await(self, state, entered, due: int | None, wanted: int | None, waits: bool) -> None:
        """One timer per run: for its earliest waiting event, else for the end of its time in the state store."""
        if wanted is not None and due != wanted and (due is None or wanted < due or not waits):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wanted)
            due = wanted
        self.known.update((state, entered, due))

    def _due(self, at_us: int) -> int:
        return -(-at_us // 1000)

    def close(self) -> None:
        pass


def latency_stream(
    events: DataFrame,
    watermark: str,
    spec: Mapping[str, tuple[str, Sequence[str]]] = LATENCIES,
    key: str = "run_id",
    state: str = "to_state",
    order: Sequence[str] = ("created_at", "id"),
    canceling: str = "CANCELING",
    keep_ms: int | None = None,
) -> DataFrame:
    """``key, order, latency, micros`` as a stream; append mode.

    Events of a run wait until the watermark has passed them and are then taken in order, so a run's latencies are those
    of the batch operator however its events arrive, also after a terminal state. Later ones are dropped. State per run
    is its waiting events and a time per start state; with ``keep_ms`` it falls when a run has been still for so long in
    event time (what it does afterwards is measured as if it had just begun), without it it stays.
    """
    ts, tie = order
    kind = events.schema[tie].dataType
    rows = events.withWatermark(ts, watermark).select(
        key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(tie).alias("tie"), F.col(state).alias("state")
    )
    out = [events.schema[key], T.StructField("at_us", T.LongType()), T.StructField("tie", kind)]
    measured = rows.groupBy(key).transformWithState(
        statefulProcessor=_LatencyProcessor(key, kind.simpleString(), spec, canceling, keep_ms),
        outputStructType=T.StructType([*out, T.StructField("latency", T.StringType()), T.StructField("micros", T.LongType())]),
        outputMode="Append",
        timeMode="EventTime",
    )
    return measured.select(key, F.timestamp_micros("at_us").alias(ts), F.col("tie").alias(tie), "latency", "micros")


def stream_latency(
    events: DataFrame,
    spec: Mapping[str, tuple[str, Sequence[str]]] = LATENCIES,
    key: str = "run_id",
    state: str = "to_state",
    order: Sequence[str] = ("created_at", "id"),
    terminal: Sequence[str] = (),
    canceling: str = "CANCELING",
) -> DataFrame:
    """Drain the stream and return the latencies of all its events: ``key, order, latency, micros, epoch``.

    Each micro-batch runs the batch operator over its events plus the few earlier ones they can refer to: per
    open run the last event and the last event into each start state. That snapshot is written next to the
    checkpoint, alternating between two folders, so a repeated batch reads what it read the first time. Runs in one of
    the ``terminal`` states leave it, which keeps it small but ends their history: what such a run does afterwards is
    measured as if it had just begun. By default no run leaves, and results are those of the batch operator.
    Batches must follow event time per run; an event older than its run's snapshot is measured against the
    events known so far.
    """
    spark: SparkSession = events.sparkSession
    root = scratch(spark, "latency")
    columns = [key, *order, state]
    starts = sorted({start for start, _ in spec.values()})
    schema = T.StructType([events.schema[c] for c in columns])

    def process(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()  # read several times below; recomputed from the source if an executor is lost
        known = (
            session.read.schema(schema).parquet(f"{root}/state-{(epoch - 1) % 2}")
            if epoch
            else session.createDataFrame([], schema)
        )
        seen = batch.select(*columns, F.lit(True).alias("__new")).unionByName(known.withColumn("__new", F.lit(False)))
        # the flag travels in the order columns: it never decides the order because they are unique
        measured = latencies(seen, spec, key, state, [*order, "__new"], canceling, HOT_BATCH_ROWS)
        try:
            measured.filter("__new").drop("__new").write.mode("overwrite").parquet(f"{root}/log/epoch={epoch}")
            snapshot = _snapshot(seen.select(*columns), key, state, order, starts, terminal)
            snapshot.write.mode("overwrite").parquet(f"{root}/state-{epoch % 2}")
        finally:
            batch.unpersist()

    run_available(events.select(*columns), f"{root}/checkpoint", process)
    out = T.StructType(
        [events.schema[c] for c in (key, *order)]
        + [T.StructField("latency", T.StringType()), T.StructField("micros", T.LongType()), T.StructField("epoch", T.IntegerType())]
    )
    return spark.read.schema(out).parquet(f"{root}/log")


HOT_BATCH_ROWS = 500_000


def _snapshot(
    seen: DataFrame, key: str, state: str, order: Sequence[str], starts: Sequence[str], terminal: Sequence[str]
) -> DataFrame:
    """Per run that is still open: its last event and its last event into each start state."""
    at, row = F.struct(*order), F.struct(*seen.columns)
    per_run = seen.groupBy(F.col(key).alias("__key")).agg(
        F.max_by(row, at).alias("last"),
        *[F.max_by(F.when(F.col(state) == s, row), F.when(F.col(state) == s, at)).alias(f"s{i}") for i, s in enumerate(starts)],
    )
    kept = F.array_distinct(F.array_compact(F.array("last", *[f"s{i}" for i in range(len(starts))])))
    return per_run.filter(~F.col(f"last.{state}").isin(*terminal)).select(F.inline(kept))
