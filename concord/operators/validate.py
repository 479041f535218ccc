"""Definitions against rules and providers, over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.functions import definition as D
from concord.functions import messages as M
from concord.functions.text import supported_versions

_FLAGS = [offer for offer, _ in D.REQUIREMENTS.values()]


# The expressions below have hundreds of terms, and making one takes longer than running it over a small table. They only
# depend on names, so a session makes each of them once.


@lru_cache(maxsize=64)
def _parsed(session: SparkSession, json: str) -> Column:
    raw = F.col("__raw")
    return D.with_defaults(raw, D.null_keys(F.col(json), raw))


@lru_cache(maxsize=64)
def _workload_errors(session: SparkSession, definition: str, api_versions: tuple[str, ...]) -> Column:
    return D.workload_errors(F.col(definition), api_versions)


@lru_cache(maxsize=64)
def _capability_errors(session: SparkSession, definition: str, capability: str) -> Column:
    w = F.col(definition)
    return D.capability_errors(w["runtime"]["spark"], w["application"]["type"], w["requirements"], F.col(capability))


def parse_definitions(df: DataFrame, json: str = "definition", out: str = "definition") -> DataFrame:
    """Parse JSON workload documents, each exactly once.

    The raw struct comes out of a one-element generator. Field accesses and filters further up are not pushed
    through a generator, which would turn every one of them into another parse of the document.
    """
    kept = [F.col(c) for c in df.columns if c != out]
    read = df.select("*", F.explode(F.array(D.read_workload(F.col(json)))).alias("__raw"))
    return read.select(*kept, _parsed(df.sparkSession, json).alias(out))


def validate_definitions(
    df: DataFrame, definition: str = "definition", api_versions: Sequence[str] = D.API_VERSIONS
) -> DataFrame:
    """Add ``errors array<string>`` and ``deprecated`` to parsed workload definitions."""
    w = F.col(definition)
    return df.withColumn("errors", _workload_errors(df.sparkSession, definition, tuple(api_versions))).withColumn(
        "deprecated", F.coalesce(D.deprecated_version(w["apiVersion"]), F.lit(False))
    )


def validate_documents(df: DataFrame, kind: str, json: str) -> DataFrame:
    """Add ``errors`` for dataset, environment or artifact documents."""
    schema, rules = {
        "Dataset": (D.DATASET_SCHEMA, D.dataset_errors),
        "Environment": (D.ENVIRONMENT_SCHEMA, D.environment_errors),
        "Artifact": (D.ARTIFACT_SCHEMA, D.artifact_errors),
    }[kind]
    return df.withColumn("errors", rules(F.from_json(F.col(json), schema)))


def upgrade_compatibility(
    df: DataFrame,
    old: Sequence[str],
    new: Sequence[str],
    definition: str = "definition",
    by: Sequence[str] = (),
) -> DataFrame:
    """``valid_before, still_valid`` under two sets of accepted API versions."""
    rules = lambda versions: _workload_errors(df.sparkSession, definition, tuple(versions))
    before, after = (F.size(rules(versions)) == 0 for versions in (old, new))
    flagged = df.select(*by, before.alias("__b"), after.alias("__a"))
    return flagged.groupBy(*by).agg(
        F.count_if("__b").alias("valid_before"), F.count_if(F.col("__b") & F.col("__a")).alias("still_valid")
    )


def capability_catalogue(profiles: DataFrame, base: DataFrame) -> DataFrame:
    """One capability row per execution profile: the provider's base row, with the profile's override versions
    added to the Spark versions.

    ``profiles``: ``profile, provider, override_versions array<string>``; ``base``: ``provider`` and capabilities.
    """
    versions = supported_versions(F.col("spark_versions"), F.col("override_versions"))
    return profiles.join(base, "provider").select(
        "profile", "provider", versions.alias("spark_versions"), "languages", *_FLAGS, "verification"
    )


def match_capabilities(workloads: DataFrame, capabilities: DataFrame, on: str, definition: str = "definition") -> DataFrame:
    """Add ``errors`` to (workload, target) rows by an equi-join on the target column ``on``.

    Which targets a workload is checked against is data (an environment or provider column of
    ``workloads``), so the output has one row per requested pair and nothing is multiplied out here.
    """
    caps = capabilities.select(
        on, F.struct("spark_versions", "languages", *_FLAGS).alias("__caps")
    )
    errors = _capability_errors(workloads.sparkSession, definition, "__caps")
    return workloads.join(caps, on, "left").withColumn("errors", errors).drop("__caps")


def for_each_target(workloads: DataFrame, targets: Sequence[str], on: str) -> DataFrame:
    """One row per workload and target name: the product of the workloads with a caller's short list of providers."""
    return workloads.withColumn(on, F.explode(F.lit(list(targets))))


def validate_workloads(workloads: DataFrame, capabilities: DataFrame, on: str, definition: str = "definition") -> DataFrame:
    """Add ``valid, errors, portability_status, provider_overrides`` to (workload, target) rows."""
    overrides = F.col(definition)["providerOverrides"]
    return (
        match_capabilities(workloads, capabilities, on, definition)
        .withColumn("valid", F.size("errors") == 0)
        .withColumn("portability_status", D.portability_status(overrides))
        .withColumn("provider_overrides", D.override_counts(overrides))
    )


def resolve_runtimes(
    df: DataFrame,
    observed: DataFrame | None = None,
    spark_version: str = "spark_version",
    override: str = "override",
    curated: Mapping[str, str] = D.CURATED_RUNTIMES,
) -> DataFrame:
    """Add ``runtime_key`` and, with ``observed`` (``key, name``), ``drift``: NULL or why the key looks stale."""
    resolved = df.withColumn("runtime_key", D.runtime_version(F.col(spark_version), F.col(override), curated))
    if observed is None:
        return resolved
    # one name per key, as the first match decides
    names = observed.groupBy(F.col("key").alias("runtime_key")).agg(F.min(F.coalesce("name", F.lit(""))).alias("__name"))
    return (
        resolved.join(names, "runtime_key", "left")
        .withColumn("drift", _drift(F.col("runtime_key"), F.col("__name"), F.col(spark_version)))
        .select(*df.columns, "runtime_key", "drift")
    )


def _drift(key: Column, name: Column, version: Column) -> Column:
    stale = M.say(M.STALE_RUNTIME, key=key, version=version)
    renamed = M.say(M.RENAMED_RUNTIME, key=key, name=name, version=version)
    return F.when(key.isNotNull() & name.isNull(), stale).when(~F.coalesce(name.contains(version), F.lit(True)), renamed)


def access_review(
    requests: DataFrame,
    grants: Mapping[str, str],
    groups: str = "groups",
    required_role: str = "required_role",
) -> DataFrame:
    """Add ``allowed`` to access rows; filter on it for rows that should have been denied."""
    return requests.withColumn("allowed", D.authorized(F.col(groups), F.col(required_role), grants))
