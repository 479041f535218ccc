"""Transition events to subscriptions: matching, payloads and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.functions.canonical import column
from concord.functions.messages import CLAIMED
from concord.functions.state import STATES, event_type

WILDCARD = "run.state_changed"


OTHER = "other"


def _match_key(heard: Column, states: Sequence[str]) -> Column:
    return F.when(heard.isin(*[f"run.{s.lower()}" for s in states]), heard).otherwise(F.lit(OTHER))


def subscription_index(subscriptions: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """``__key, __heard`` and the subscription columns: what :func:`heard_by` joins events with.

    The wildcard (``__heard`` NULL) is spelled out on this, the small side: a row per listed state's event type and one
    for all other types, so that events of any state are matched by an equi-join and each (event, subscription) pair
    appears once. A subscription to a type that is not listed waits under the same key for that type alone.
    """
    keys = F.lit([*[f"run.{s.lower()}" for s in states], OTHER])
    every = F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("heard")))
    named = F.transform(
        F.array_compact(F.array_distinct("event_types")), lambda t: F.struct(_match_key(t, states).alias("key"), t.alias("heard"))
    )
    heard = F.when(F.array_contains("event_types", WILDCARD), every).otherwise(named)
    listed = subscriptions.filter("enabled").withColumn("__e", F.explode(heard)).drop("event_types", "enabled")
    return listed.withColumns({"__key": F.col("__e.key"), "__heard": F.col("__e.heard")}).drop("__e")


def heard_by(
    events: DataFrame, index: DataFrame, states: Sequence[str] = STATES, pieces: int | None = None, shares: DataFrame | None = None
) -> DataFrame:
    """``events`` (with ``event_type``) joined with the subscriptions of :func:`subscription_index` that hear them.

    There are few event types, so joined on these alone an index that is too large to be broadcast gives few tasks. With
    ``pieces`` the events of a type are dealt out to as many pieces as its share of all events asks for, ``pieces`` for all
    types together and at least one for each, and the subscriptions to the type are copied to each of its pieces.
    ``shares`` (:func:`type_shares`, of the events if not given) says how many events each type has; a stream needs it.
    """
    keyed = events.withColumn("__key", _match_key(F.col("event_type"), states))
    on = ["__key"]
    if pieces is not None:
        counted = type_shares(events, states) if shares is None else shares
        total = F.sum("__events").over(Window.partitionBy())  # at most a row per state and one for all others
        dealt = counted.select("__key", F.ceil(F.lit(pieces) * F.col("__events") / total).cast("int").alias("__pieces"))
        dealt = F.broadcast(dealt)
        row = F.xxhash64(*[column(c) for c, kind in events.dtypes if "map<" not in kind])
        whole = F.coalesce("__pieces", F.lit(1))  # types that the shares do not know
        keyed = keyed.join(dealt, "__key", "left").withColumn("__piece", F.pmod(row, whole).cast("int")).drop("__pieces")
        index = index.join(dealt, "__key", "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), whole - 1))).drop("__pieces")
        on = ["__key", "__piece"]
    hears = F.col("__heard").isNull() | (F.col("__heard") == F.col("event_type"))
    return keyed.join(index, on).where(hears).drop("__heard", *on)


def type_shares(events: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """``__key, __events``: how many events (with ``event_type``) there are for each key of the index."""
    return events.groupBy(_match_key(F.col("event_type"), states).alias("__key")).agg(F.count(F.lit(1)).alias("__events"))


def match_subscriptions(
    events: DataFrame,
    subscriptions: DataFrame,
    state: str = "to_state",
    states: Sequence[str] = STATES,
    message: str | None = None,
    from_state: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """One delivery row per event and matching subscription.

    ``pieces``: see :func:`heard_by`; for subscriptions that are too many to be broadcast.

    With ``from_state`` and ``message`` given, a run's first event and its claim events are left out: they
    are written without notifying anybody.
    """
    if from_state is not None:
        events = events.filter(F.col(from_state).isNotNull())
    if message is not None:
        events = events.filter(~F.col(message).eqNullSafe(F.lit(CLAIMED)))
    typed = events.withColumn("event_type", event_type(F.col(state)))
    return heard_by(typed, subscription_index(subscriptions, states), states, pieces)


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only where there are any (session time zone must be UTC)."""
    whole = F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def json_text(value: Column) -> Column:
    """A JSON string of ASCII characters alone, as a signer renders it; NULL becomes null.

    Printable ASCII stays, quotes and backslashes are escaped, everything else becomes ``\\uXXXX`` (or a short escape),
    characters beyond U+FFFF as two of them.
    """
    code = lambda number: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(number), 4, "0")))
    short = F.create_map(*[F.lit(x) for pair in _SHORT_ESCAPES.items() for x in pair])

    def escaped(c: Column) -> Column:
        number = F.ascii(c)
        beyond = number - 0x10000
        pair = F.concat(code(F.shiftright(beyond, 10) + 0xD800), code(beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return (
            F.when(c.rlike(_PLAIN), c)
            .when(short[c].isNotNull(), short[c])
            .when(number >= 0x10000, pair)
            .otherwise(code(number))
        )

    mended = F.array_join(F.transform(F.split(value, ""), escaped), "")
    return F.when(value.isNull(), "null").otherwise(
        F.concat(F.lit('"'), F.when(value.rlike(_PLAIN), value).otherwise(mended), F.lit('"'))
    )


# JSON's short escapes, and what needs none.
_SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
_PLAIN = r"^[ !#-\[\]-~]*\z"


def event_payload(
    run_id: Column,
    workload_name: Column,
    workload_version: Column,
    environment_name: Column,
    from_state: Column,
    to_state: Column,
    message: Column,
    timestamp: Column,
) -> Column:
    """The 8-key JSON envelope of a transition as the signed body has it: NULLs written out, a blank after each colon
    and comma, ASCII only."""
    fields = {
        "run_id": run_id.cast("string"),
        "workload_name": workload_name,
        "workload_version": workload_version,
        "environment_name": environment_name,
        "from_state": from_state,
        "to_state": to_state,
        "message": message,
        "timestamp": iso_timestamp(timestamp),
    }
    members = [F.concat(F.lit(f'"{name}": '), json_text(c)) for name, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


_HEX = "0123456789ABCDEF"
_BLOCK = 64


def _pad(key_hex: Column, byte: int) -> Column:
    """Key block XOR a repeated byte, digit by digit on hex text."""
    swapped = {shift: "".join(_HEX[int(d, 16) ^ ((byte >> shift) & 15)] for d in _HEX) for shift in (4, 0)}
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(_BLOCK - 1)),
        lambda i: F.concat(
            F.translate(F.substr(key_hex, i * 2 + 1, F.lit(1)), _HEX, swapped[4]),
            F.translate(F.substr(key_hex, i * 2 + 2, F.lit(1)), _HEX, swapped[0]),
        ),
    )
    return F.unhex(F.array_join(digits, ""))


def signing_key(secret: Column) -> Column:
    """struct(inner, outer): the two padded keys of HMAC-SHA256. Computed once per subscription."""
    raw = F.encode(secret, "UTF-8")
    block = F.when(F.octet_length(raw) > _BLOCK, F.sha2(raw, 256)).otherwise(F.hex(raw))
    block = F.rpad(F.upper(block), 2 * _BLOCK, "0")
    return F.struct(_pad(block, 0x36).alias("inner"), _pad(block, 0x5C).alias("outer"))


def sign(payload: Column, key: Column) -> Column:
    """HMAC-SHA256 of the payload text as hex, from built-in hashes only."""
    inner = F.unhex(F.sha2(F.concat(key["inner"], F.encode(payload, "UTF-8")), 256))
    return F.sha2(F.concat(key["outer"], inner), 256)


def signed_deliveries(deliveries: DataFrame, subscriptions: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``signature`` to deliveries (``subscription_id``); the secret never leaves the key computation."""
    keys = subscriptions.select("subscription_id", signing_key(F.col("secret")).alias("__key"))
    return deliveries.join(keys, "subscription_id").withColumn("signature", sign(F.col(payload), F.col("__key"))).drop("__key")
