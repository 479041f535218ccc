"""Reports over run history, environments and datasets."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from concord.functions import messages as M
from concord.functions.state import TERMINAL_STATES
from concord.functions.uri import storage_protocol
from concord.operators.compare import compare_tables, joined_parts, merged_parts, mismatch_text, profile_mismatches, profile_row
from concord.operators.ledger import file_parts, ordered_fields
from concord.session import scratch
from concord.sources.datasets import scan

# -- counts -----------------------------------------------------------------------------------------------


def state_counts(runs: DataFrame, state: str = "state") -> DataFrame:
    return runs.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("runs"))


def runs_created(idempotent: DataFrame) -> DataFrame:
    """Runs really created: rows of ``idempotent_first`` that are their own winner."""
    return idempotent.filter("created").agg(F.count(F.lit(1)).alias("runs_created"))


def terminal_transitions(events: DataFrame, state: str = "to_state", terminal: Sequence[str] = TERMINAL_STATES) -> DataFrame:
    hits = events.filter(F.col(state).isin(*terminal))
    return hits.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("transitions"))


def api_errors(requests: DataFrame) -> DataFrame:
    """``method, route, status_code, errors``: responses of 400 and up; a raised exception counts as 500.

    ``requests``: ``method, route, status_code`` with a NULL status where the handler raised.
    """
    status = F.coalesce(F.col("status_code").cast("int"), F.lit(500))
    return (
        requests.withColumn("status_code", status)
        .filter("status_code >= 400")
        .groupBy("method", "route", "status_code")
        .agg(F.count(F.lit(1)).alias("errors"))
    )


def provider_errors(events: DataFrame, failed: str, by: Sequence[str] = ("provider",)) -> DataFrame:
    """Count of events matched by the SQL predicate ``failed``."""
    return events.filter(failed).groupBy(*by).agg(F.count(F.lit(1)).alias("errors"))


def failure_breakdown(failures: DataFrame, by: Sequence[str] = ("category", "disposition", "provider")) -> DataFrame:
    return failures.groupBy(*by).agg(F.count(F.lit(1)).alias("failures"))


def audit_summary(audit: DataFrame, by: Sequence[str] = ("identity", "action", "result")) -> DataFrame:
    return audit.groupBy(*by).agg(F.count(F.lit(1)).alias("actions"))


def latency_histogram(df: DataFrame, bounds: Sequence[int], value: str = "micros", by: Sequence[str] = ("latency",)) -> DataFrame:
    """Cumulative histogram: ``by, le, cumulative, count, total``; ``bounds`` in the unit of ``value``.

    One pass: a count per bound, so nothing is joined and a hot label costs one row per task.
    """
    buckets = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    grouped = df.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("total"), *buckets)
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))
    return grouped.select(*by, F.inline(F.array(*rows)), "count", "total")


def reconciliation_lag(
    loops: DataFrame, now: Column, process: str = "process", ts: str = "finished_at", success: Column | None = None
) -> DataFrame:
    """Microseconds since the last successful loop per process; a process without one has no row.

    ``success`` tells which loops count; without it every row is a successful loop.
    """
    last = (loops if success is None else loops.filter(success)).groupBy(process).agg(F.max(ts).alias("__last"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return last.select(process, (micros(now) - micros(F.col("__last"))).alias("lag_micros"))


# -- portability and reliability --------------------------------------------------------------------------


def portability_rate(executions: DataFrame, workload: str = "workload", provider: str = "provider", overrides: str = "overrides") -> DataFrame:
    """``workloads, portable``: workloads that ran on two or more providers without any override.

    Only "more than one provider" matters, so the smallest and largest provider name decide and no distinct
    shuffle is needed.
    """
    per = executions.groupBy(workload).agg(
        (F.min(provider) != F.max(provider)).alias("several"), F.max(overrides).alias("overrides")
    )
    portable = F.col("several") & (F.col("overrides") == 0)
    return per.agg(F.count(F.lit(1)).alias("workloads"), F.count_if(portable).alias("portable"))


def run_reliability(
    events: DataFrame,
    submissions: DataFrame,
    run: str = "run_id",
    state: str = "to_state",
    category: str = "category",
    key: str = "key",
) -> DataFrame:
    """``submitted, reconciliation_failures, lost, duplicate_executions``.

    ``submissions`` has one row per run with its idempotency key: every further run of a key is a duplicate.
    """
    per_run = events.groupBy(run).agg(
        F.bool_or(F.col(state) == "QUEUED").alias("q"),
        F.bool_or((F.col(state) == "FAILED") & (F.col(category) == "UNKNOWN_RECONCILIATION")).alias("f"),
        F.bool_or(F.col(state) == "LOST").alias("l"),
    )
    totals = per_run.agg(
        F.count_if("q").alias("submitted"),
        F.count_if("f").alias("reconciliation_failures"),
        F.count_if("l").alias("lost"),
    )
    duplicates = (
        submissions.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_executions"))
    )
    nothing = F.lit(0).cast("bigint")
    names = ["submitted", "reconciliation_failures", "lost", "duplicate_executions"]
    rows = totals.withColumn("duplicate_executions", nothing).unionByName(
        duplicates.select(*[nothing.alias(n) for n in names[:3]], "duplicate_executions")
    )
    return rows.agg(*[F.sum(n).alias(n) for n in names])


def unpolled_runs(runs: DataFrame, state: str = "state") -> DataFrame:
    """Runs that are neither active nor finished nor waiting: nothing will ever advance them."""
    return runs.filter(F.col(state).isin("UNKNOWN", "VALIDATING"))


def certification_report(
    environments: DataFrame,
    execution_profiles: DataFrame,
    storage_profiles: DataFrame,
    evidence: DataFrame,
    worst: bool = False,
) -> DataFrame:
    """``execution_provider, storage_protocol, status, detail``: one row per pair in use.

    The first environment by name decides a pair (``worst=True``: any failing environment does). A failing
    execution side is FAIL; evidence for exactly this pair is PASS; anything else BLOCKED.

    ``execution_profiles``: ``name, provider, spark_versions`` and, if known, ``check_error``, the reason why a check
    of the provider failed; ``storage_profiles``: ``name, provider, config``; ``evidence``: ``execution_provider,
    storage_protocol``.
    """
    none = F.lit(None).cast("string")
    failed = F.col("check_error") if "check_error" in execution_profiles.columns else none
    broken = F.when(failed.isNotNull(), failed).when(
        F.coalesce(F.size("spark_versions"), F.lit(0)) <= 0,
        F.lit(M.NO_SPARK_VERSIONS),
    ).otherwise(none)
    execution = execution_profiles.select(
        F.col("name").alias("execution_profile_name"), F.col("provider").alias("execution_provider"), broken.alias("broken")
    )
    storage = storage_profiles.select(
        F.col("name").alias("storage_profile_name"),
        storage_protocol(F.col("provider"), F.col("config")).alias("storage_protocol"),
    )
    pair = ["execution_provider", "storage_protocol"]
    joined = (
        environments.select("name", "execution_profile_name", "storage_profile_name")
        .join(execution, "execution_profile_name")
        .join(storage, "storage_profile_name")
    )
    order = F.struct(F.col("broken").isNull(), "name") if worst else F.struct("name")
    # boxed, because a NULL detail must win as well
    decided = joined.groupBy(*pair).agg(F.min_by(F.struct("broken"), order)["broken"].alias("broken"))
    proven = evidence.select(*pair).distinct().withColumn("proven", F.lit(True))
    status = F.when(F.col("broken").isNotNull(), "FAIL").when(F.col("proven"), "PASS").otherwise("BLOCKED")
    detail = F.coalesce(
        F.col("broken"),
        F.when(F.col("proven").isNull(), F.lit(M.NO_EVIDENCE)),
    )
    return decided.join(proven, pair, "left").select(*pair, status.alias("status"), detail.alias("detail"))


def performance_delta(left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``keys, metric, left, right, difference, ratio`` for metric rows of two runs; information, no verdict."""
    boxed = lambda side: F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias(side)
    joined = left.select(*keys, boxed("l")).join(right.select(*keys, boxed("r")), list(keys), "full_outer")
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(f"l.{m}").alias("left"), F.col(f"r.{m}").alias("right")) for m in metrics
    ]
    return joined.select(*keys, F.inline(F.array(*rows))).select(
        "*",
        (F.col("right") - F.col("left")).alias("difference"),
        F.try_divide(F.col("right"), F.col("left")).alias("ratio"),
    )


# -- outputs of several runs ------------------------------------------------------------------------------

def run_pairs(spark: SparkSession, run_ids: Sequence[str]) -> DataFrame:
    """``pair, left_position, right_position`` for the runs named in one request, in request order.

    The list comes from a caller, not from a table, and the answer has a row for each of its pairs, made on the
    executors. Where only the question which outputs agree matters, :func:`equivalence_classes` is linear.
    """
    n, here, before = len(run_ids), F.col("left_position"), F.col("left_position").cast("bigint")
    number = before * n - F.expr("left_position * CAST(left_position + 1 AS BIGINT) div 2") + F.col("right_position") - here - 1
    return (
        spark.range(n)
        .select(F.col("id").cast("int").alias("left_position"))
        .where(here < n - 1)
        .select("left_position", F.explode(F.sequence(here + 1, F.lit(n - 1))).alias("right_position"))
        .select(number.alias("pair"), "left_position", "right_position")
    )


def resolve_legs(
    requested: DataFrame, runs: DataFrame, definitions: DataFrame, bindings: DataFrame, output: str | None = None
) -> DataFrame:
    """One row per requested run: ``position, run_id, environment_name, kind, uri, reason``.

    ``reason`` is NULL when the output can be read; otherwise the first obstacle: unknown run, run not
    SUCCEEDED, no outputs, no output of that name, no binding. ``definitions`` are parsed (``name, version,
    definition``).
    """
    # the requested ids reduce the history first, so that a short list costs a scan and no shuffle of it
    named = runs.join(requested.select(F.col("run_id").alias("__wanted")), F.col("id") == F.col("__wanted"), "left_semi")
    found = (
        requested.join(
            named.select(
                F.col("id").alias("run_id"),
                F.col("workload_name").alias("__name"),
                F.col("workload_version").alias("__version"),
                "environment_name",
                F.col("state").alias("__state"),
            ),
            "run_id",
            "left",
        )
        .join(
            definitions.select(
                F.col("name").alias("__name"), F.col("version").alias("__version"), F.col("definition.outputs").alias("__outputs")
            ),
            ["__name", "__version"],
            "left",
        )
    )
    if output is None:
        dataset = F.get("__outputs", F.lit(0))["dataset"]
    else:
        dataset = F.get(F.filter("__outputs", lambda o: o["name"] == output), F.lit(0))["dataset"]
    bound = bindings.select(
        F.col("dataset_name").alias("__dataset"), "environment_name", F.col("kind").alias("__kind"), F.col("uri").alias("__uri")
    )
    joined = found.withColumn("__dataset", dataset).join(bound, ["__dataset", "environment_name"], "left")
    unbound = M.say(M.UNBOUND_OUTPUT, dataset=F.col("__dataset"), environment=F.col("environment_name"))
    reason = (
        F.when(F.col("__state").isNull(), M.say(M.RUN_NOT_FOUND, run=F.col("run_id")))
        .when(F.col("__state") != "SUCCEEDED", M.say(M.RUN_NOT_SUCCEEDED, state=F.col("__state")))
        .when(F.coalesce(F.size("__outputs"), F.lit(0)) <= 0, M.NO_OUTPUTS)
        .when(F.col("__dataset").isNull(), M.say(M.NO_SUCH_OUTPUT, output=F.lit(output)))
        .when(F.col("__uri").isNull(), unbound)
    )
    ready = lambda c: F.when(reason.isNull(), F.col(c))
    return joined.select(
        "position",
        "run_id",
        F.coalesce("environment_name", "run_id").alias("environment_name"),
        ready("__kind").alias("kind"),
        ready("__uri").alias("uri"),
        reason.alias("reason"),
    )


PROFILE = (
    "kind string, uri string, p struct<rows:bigint,columns:array<struct<name:string,type:string,numeric:boolean,"
    "nulls:bigint,sum:string,min:string,max:string,wide_rows:bigint,wide_sum:double>>,fingerprint:string>"
)
#: Locations profiled one by one in one plan.
LOCATIONS_PER_PLAN = 32
#: Locations whose schema is looked up at the same time.
LOOKUPS = 16


def _file_form(path: str) -> str:
    """A path as the scan reports it."""
    return re.sub("^file:/+", "file:/", path)


def _groups(located: list[tuple[str, str]], read: Callable[[str, str], DataFrame]) -> tuple[dict, list]:
    """(schema -> uri -> its files, locations to be read alone): flat folders of files can share a scan."""

    def look(location: tuple[str, str]) -> tuple[str, list[str]]:
        df = read(*location)
        return df.schema.json(), [_file_form(f) for f in df.inputFiles()] if location[0] == "path" else []

    with ThreadPoolExecutor(LOOKUPS) as pool:
        found = list(pool.map(look, located))
    shared: dict[str, dict[str, list[str]]] = {}
    alone = []
    for (kind, uri), (schema, files) in zip(located, found, strict=True):
        # columns that are folder names (key=value) belong to one root only
        if files and not any("=" in f.rsplit("/", 1)[0] for f in files):
            shared.setdefault(schema, {})[uri] = files
        else:
            alone.append((kind, uri))
    return shared, alone


def _roots(uris: dict[str, list[str]]) -> list[str]:
    """Locations that hold all files between them, each once."""
    roots, seen = [], set()
    for uri in sorted(uris, key=lambda u: -len(uris[u])):
        if not seen.issuperset(uris[uri]):
            roots.append(uri)
            seen.update(uris[uri])
    return roots


def profile_locations(
    spark: SparkSession,
    legs: DataFrame,
    read: Callable[[str, str], DataFrame],
    read_files: Callable[[list[str], T.StructType], DataFrame] | None = None,
) -> DataFrame:
    """``kind, uri, p``: one profile per distinct location of the ready legs. Each location is read once.

    ``read`` opens a location. With ``read_files``, which reads several folders of one schema, locations of the same schema
    are one scan, profiled by file, and a location's files are added up; tables and folders with partition columns are
    profiled one by one. The driver holds the locations of the request and the paths of their files, as their scans do.
    The profiles, a row each, are written and read back.
    """
    located = sorted(tuple(r) for r in legs.filter("reason IS NULL").select("kind", "uri").distinct().collect())
    path = scratch(spark, "profiles")
    spark.createDataFrame([], PROFILE).write.parquet(path)
    shared, alone = _groups(located, read) if read_files else ({}, located)
    for text, uris in shared.items():
        schema = T.StructType.fromJson(json.loads(text))
        held = [(uri, f) for uri, files in uris.items() for f in files]
        of_file = spark.createDataFrame(pa.table({"uri": [u for u, _ in held], "file": [f for _, f in held]}))
        parts = file_parts(read_files(_roots(uris), schema))
        per_uri = merged_parts(of_file.join(parts, "file", "left"), ["uri"])
        profiles = joined_parts(per_uri, ordered_fields(schema), keys=["uri"])
        row = F.struct("rows", "columns", "fingerprint").alias("p")
        profiles.select(F.lit("path").alias("kind"), "uri", row).write.mode("append").parquet(path)
    for start in range(0, len(alone), LOCATIONS_PER_PLAN):
        profiles = [
            profile_row(read(kind, uri)).select(F.lit(kind).alias("kind"), F.lit(uri).alias("uri"), F.struct("*").alias("p"))
            for kind, uri in alone[start : start + LOCATIONS_PER_PLAN]
        ]
        reduce(DataFrame.unionByName, profiles).write.mode("append").parquet(path)
    return spark.read.schema(PROFILE).parquet(path)


# -- classes of equal outputs -----------------------------------------------------------------------------


def run_classes(legs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``class`` to the legs: the position of the first run with the same schema and content; NULL if it cannot be read."""
    shape = F.transform(F.col("p.columns"), lambda c: F.struct(c["name"], c["type"]))
    content = F.when(F.col("p").isNotNull(), F.struct(F.to_json(shape).alias("shape"), F.col("p.fingerprint").alias("rows")))
    known = legs.join(profiles, ["kind", "uri"], "left").select(*legs.columns, content.alias("content"))
    first = known.where("content IS NOT NULL").groupBy("content").agg(F.min("position").alias("class"))
    return known.join(first, "content", "left").drop("content").select(*legs.columns, "class")


def class_differences(classes: DataFrame, profiles: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """``left_class, right_class, mismatches``: what tells two classes apart, from a profile of each.

    A row for each pair of classes, the one that was requested first on the left, however many runs there are in them.
    """
    firsts = classes.where(F.col("class") == F.col("position")).join(profiles, ["kind", "uri"])
    side = lambda s: firsts.select(F.col("class").alias(f"{s}_class"), F.col("p").alias(f"{s}_p"))
    # every class is compared with the classes after it: its position is listed for each of them
    positions = firsts.agg(F.sort_array(F.collect_list("class")).alias("all"))
    pairs = positions.select(F.explode("all").alias("left_class"), "all").select(
        "left_class", F.explode(F.filter("all", lambda c: c > F.col("left_class"))).alias("right_class")
    )
    found = F.transform(profile_mismatches(F.col("left_p"), F.col("right_p"), rtol), mismatch_text)
    return pairs.join(side("left"), "left_class").join(side("right"), "right_class").select(
        "left_class", "right_class", found.alias("mismatches")
    )


def compare_runs(legs: DataFrame, pairs: DataFrame, profiles: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """:func:`pair_report` from legs and profiles."""
    classes = run_classes(legs, profiles)
    return pair_report(pairs, classes, class_differences(classes, profiles, rtol))


def pair_report(pairs: DataFrame, classes: DataFrame, differences: DataFrame) -> DataFrame:
    """``pair, left_environment, right_environment, status, mismatches`` for the given pairs of positions.

    A pair looks its answer up: runs of one class agree, others differ as their classes do.
    """
    side = lambda s: classes.select(
        F.col("position").alias(f"{s}_position"),
        F.col("environment_name").alias(f"{s}_environment"),
        F.col("reason").alias(f"{s}_reason"),
        F.col("class").alias(f"{s}_class"),
    )
    compared = pairs.join(side("left"), "left_position").join(side("right"), "right_position")
    # class numbers are positions, so either order of a pair finds the one row of its classes
    ends = differences.select(
        F.col("left_class").alias("low"), F.col("right_class").alias("high"), F.col("mismatches").alias("found")
    )
    both = (F.least("left_class", "right_class") == F.col("low")) & (F.greatest("left_class", "right_class") == F.col("high"))
    blocked = F.coalesce("left_reason", "right_reason")
    found = F.coalesce("found", F.array().cast("array<string>"))
    mismatches = F.when(blocked.isNotNull(), F.array(blocked)).otherwise(found)
    status = F.when(blocked.isNotNull(), "BLOCKED").when(F.size(found) == 0, "PASS").otherwise("FAIL")
    return compared.join(ends, both, "left").select(
        "pair", "left_environment", "right_environment", status.alias("status"), mismatches.alias("mismatches")
    )


@dataclass(frozen=True)
class Conformance:
    """What a request found out: ``runs`` (a row per run with its class), ``differences`` (a row per pair of classes)."""

    runs: DataFrame
    differences: DataFrame


def conformance_classes(
    spark: SparkSession,
    run_ids: Sequence[str],
    runs: DataFrame,
    definitions: DataFrame,
    bindings: DataFrame,
    output: str | None = None,
    format: str = "parquet",
    rtol: float = 1e-9,
) -> Conformance:
    """The outputs of the named runs by class: linear in the runs, whose outputs are read once each.

    ``definitions`` hold parsed workload documents; tables are read by the identifier in ``bindings``.
    """
    # as an Arrow table its size is known to the optimizer, which then broadcasts a short list by itself
    positions = pa.array(range(len(run_ids)), pa.int32())
    requested = spark.createDataFrame(pa.table({"position": positions, "run_id": pa.array(run_ids, pa.string())}))
    path = scratch(spark, "legs")  # read for the locations and for the classes
    resolve_legs(requested, runs, definitions, bindings, output).write.parquet(path)
    legs = spark.read.parquet(path)
    profiles = profile_locations(
        spark,
        legs,
        lambda kind, location: scan(spark, kind, location, format),
        lambda locations, schema: spark.read.format(format).schema(schema).option("header", format == "csv").load(locations),
    )
    stored = scratch(spark, "classes")  # read for the runs, their pairs and the differences
    run_classes(legs, profiles).write.parquet(stored)
    classes = spark.read.parquet(stored)
    return Conformance(classes, class_differences(classes, profiles, rtol))


def conformance_report(
    spark: SparkSession,
    run_ids: Sequence[str],
    runs: DataFrame,
    definitions: DataFrame,
    bindings: DataFrame,
    output: str | None = None,
    format: str = "parquet",
    pairs: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Compare the outputs of the named runs pair by pair: from run ids to PASS / FAIL / BLOCKED rows.

    ``pairs`` names the positions to compare with each other; by default every run is compared with all after it. Lists
    of mismatches are made once for each pair of classes (:func:`conformance_classes`), which alone is linear in the runs.
    """
    found = conformance_classes(spark, run_ids, runs, definitions, bindings, output, format)
    if pairs is None:
        wanted = run_pairs(spark, run_ids)
    else:
        columns = [range(len(pairs)), [left for left, _ in pairs], [right for _, right in pairs]]
        names = ("pair", "left_position", "right_position")
        types = (pa.int64(), pa.int32(), pa.int32())
        wanted = spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}))
    return pair_report(wanted, found.runs, found.differences)


def compare_semantic(
    spark: SparkSession, left: str, right: str, kind: str = "path", format: str = "parquet", **options
) -> DataFrame:
    """:func:`~concord.operators.compare.compare_tables` for two locations or two table identifiers."""
    return compare_tables(*[scan(spark, kind, location, format) for location in (left, right)], **options)


def equivalence_classes(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``class`` (the smallest key with the same schema and content) and ``members`` to profiled datasets.

    Two datasets agree exactly when they share a class: the linear form of all pairs.
    """
    shape = F.transform(F.col("p.columns"), lambda c: F.struct(c["name"], c["type"]))
    content = F.sha2(F.to_json(F.struct(shape.alias("columns"), F.col("p.fingerprint").alias("rows"))), 256)
    keyed = profiles.select(*keys, content.alias("__content"))
    classes = keyed.groupBy("__content").agg(
        F.min(F.struct(*keys)).alias("class"), F.count(F.lit(1)).alias("members")
    )
    return keyed.join(classes, "__content").drop("__content")

