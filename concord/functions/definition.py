"""Workload, dataset, environment and artifact documents: JSON text to columns, and row-level rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from concord.functions import messages as M

# Document versions and closed vocabularies.
STABLE_VERSION = "runtime/v1"
DEPRECATED_VERSION = "runtime/v1alpha1"
API_VERSIONS = (STABLE_VERSION, DEPRECATED_VERSION)
APPLICATION_TYPES = ("python-wheel", "jvm-jar", "spark-declarative-pipeline")
EXECUTION_PROVIDERS = ("kubernetes", "databricks")
DATA_PROVIDERS = ("s3", "vast", "adls")
BINDING_KINDS = ("path", "table")
ROLES = ("Viewer", "Analyst", "Developer", "Operator", "PlatformAdmin")
REQUIREMENTS = {
    "dynamicAllocation": ("dynamic_allocation", "dynamic allocation"),
    "gpu": ("gpu", "GPU"),
    "streaming": ("streaming", "streaming"),
    "localDisk": ("local_disk", "local disk"),
    "sparkConnect": ("spark_connect", "Spark Connect"),
}
# Runtime keys curated per Spark version.
CURATED_RUNTIMES = {"4.0": "17.3.x-scala2.13", "4.1": "18.2.x-scala2.13", "4.2": "19.x-scala2.13"}

# Scalars are read as text and cast afterwards, so "2" and 2 are the same number of cores.
_REFS = "map<string,struct<dataset:string>>"
_SIZE = "struct<cores:string,memory:string>"
_FLAGS = ",".join(f"{name}:string" for name in REQUIREMENTS)
WORKLOAD_SCHEMA = (
    "struct<apiVersion:string,kind:string,metadata:struct<name:string,version:string>,"
    "runtime:struct<spark:string,profile:string>,"
    "application:struct<type:string,artifact:string,entryPoint:string,pipelineSpec:string>,"
    f"arguments:array<string>,datasets:struct<inputs:{_REFS},outputs:{_REFS}>,"
    f"resources:struct<driver:{_SIZE},executor:{_SIZE},scaling:struct<minExecutors:string,maxExecutors:string>>,"
    "execution:struct<timeout:string,retries:string>,"
    f"requirements:struct<{_FLAGS}>,providerOverrides:map<string,map<string,string>>>"
)
DATASET_SCHEMA = (
    "struct<apiVersion:string,kind:string,metadata:struct<name:string>,"
    "bindings:map<string,struct<kind:string,uri:string,identifier:string>>>"
)
ENVIRONMENT_SCHEMA = (
    "struct<apiVersion:string,kind:string,metadata:struct<name:string>,"
    "execution:struct<provider:string,profile:string>,data:struct<provider:string,profile:string>>"
)
ARTIFACT_SCHEMA = (
    "struct<apiVersion:string,kind:string,metadata:struct<name:string,version:string>,"
    "bindings:map<string,struct<kind:string,uri:string>>>"
)


def read_workload(json: Column) -> Column:
    """The document as written."""
    return F.from_json(json, WORKLOAD_SCHEMA)


# The texts that are read as true and as false, in any case.
TRUE_TEXTS = ("true", "t", "yes", "y", "on", "1")
FALSE_TEXTS = ("false", "f", "no", "n", "off", "0")


#: Top-level keys that may be missing but not null.
NOT_NULL = ("arguments", "requirements", "providerOverrides")


def null_keys(json: Column, raw: Column) -> Column:
    """Which of :data:`NOT_NULL` a document has with an explicit null.

    Reading a document as a struct does not tell that from a missing key. It is read for its keys only where one of them is
    NULL in ``raw`` (:func:`read_workload`) and yet written in the text, or may be with escapes.
    """
    written = lambda name: F.contains(json, F.lit(f'"{name}"')) | F.contains(json, F.lit("\\u"))
    doubtful = [raw[name].isNull() & written(name) for name in NOT_NULL]
    top = F.from_json(json, "map<string,string>")
    found = F.filter(F.lit(list(NOT_NULL)), lambda name: F.array_contains(F.map_keys(top), name) & top[name].isNull())
    return F.when(doubtful[0] | doubtful[1] | doubtful[2], found)


def _whole(text: Column) -> Column:
    """A whole number written as one, with or without zero decimals; NULL for anything else."""
    return F.regexp_replace(text, r"\.0+$", "").try_cast("int")


def _truth(text: Column) -> Column:
    lower = F.lower(F.trim(text))
    return F.when(lower.isin(*TRUE_TEXTS), F.lit(True)).when(lower.isin(*FALSE_TEXTS), F.lit(False))


def _type_errors(raw: Column, nulls: Column | None) -> Column:
    """What is there but not of its type. Compares each raw text with what became of it."""
    scaling = raw["resources"]["scaling"]
    numbers = {
        "resources.driver.cores": raw["resources"]["driver"]["cores"],
        "resources.executor.cores": raw["resources"]["executor"]["cores"],
        "resources.scaling.minExecutors": scaling["minExecutors"],
        "resources.scaling.maxExecutors": scaling["maxExecutors"],
        "execution.retries": raw["execution"]["retries"],
    }
    flags = {f"requirements.{name}": raw["requirements"][name] for name in REQUIREMENTS}
    found = [
        F.when(text.isNotNull() & made(text).isNull(), M.say(f"{name} must be {kind}: {{value}}", value=text))
        for fields, made, kind in ((numbers, _whole, "a whole number"), (flags, _truth, "true or false"))
        for name, text in fields.items()
    ]
    if nulls is not None:
        found += [F.when(F.array_contains(nulls, name), F.lit(f"{name} must not be null")) for name in NOT_NULL]

    def unnamed(side: str) -> Column:
        entries = F.map_entries(F.coalesce(raw["datasets"][side], F.create_map().cast(_REFS)))
        lost = F.filter(entries, lambda e: e["value"]["dataset"].isNull())
        return F.transform(lost, lambda e: M.say(f"missing datasets.{side}.{{name}}.dataset", name=e["key"]))

    return F.concat(F.array_compact(F.array(*found)), unnamed("inputs"), unnamed("outputs"))


def with_defaults(raw: Column, nulls: Column | None = None) -> Column:
    """The workload struct with defaults filled in, from a column that holds :func:`read_workload`.

    ``outputs`` keeps the declared order, which decides the output used when none is named. ``typeErrors`` lists what
    could not be read as its type; ``nulls`` are the keys of :func:`null_keys`.
    """
    refs = lambda side: F.coalesce(raw["datasets"][side], F.create_map().cast(_REFS))
    number = _whole
    size = lambda col: F.struct(number(col["cores"]).alias("cores"), col["memory"].alias("memory"))
    flag = lambda name: F.coalesce(_truth(raw["requirements"][name]), F.lit(False)).alias(name)
    scaling = raw["resources"]["scaling"]
    listed = lambda side: F.transform(
        F.map_entries(refs(side)),
        lambda e: F.struct(e["key"].alias("name"), e["value"]["dataset"].alias("dataset")),
    )
    return F.struct(
        raw["apiVersion"].alias("apiVersion"),
        raw["kind"].alias("kind"),
        raw["metadata"].alias("metadata"),
        raw["runtime"].alias("runtime"),
        raw["application"].alias("application"),
        F.coalesce(raw["arguments"], F.array().cast("array<string>")).alias("arguments"),
        raw["datasets"].isNotNull().alias("hasDatasets"),
        listed("inputs").alias("inputs"),
        listed("outputs").alias("outputs"),
        F.struct(
            size(raw["resources"]["driver"]).alias("driver"),
            size(raw["resources"]["executor"]).alias("executor"),
            F.struct(
                number(scaling["minExecutors"]).alias("minExecutors"),
                number(scaling["maxExecutors"]).alias("maxExecutors"),
            ).alias("scaling"),
        ).alias("resources"),
        F.struct(
            raw["execution"]["timeout"].alias("timeout"),
            F.coalesce(number(raw["execution"]["retries"]), F.lit(0)).alias("retries"),
        ).alias("execution"),
        F.struct(*[flag(name) for name in REQUIREMENTS]).alias("requirements"),
        F.coalesce(raw["providerOverrides"], F.create_map().cast("map<string,map<string,string>>")).alias(
            "providerOverrides"
        ),
        _type_errors(raw, nulls).alias("typeErrors"),
    )


def _required(fields: Mapping[str, Column], mistyped: Column | None = None) -> list[Column]:
    """An error per missing field; what ``mistyped`` already reports is there, only not readable."""
    known = lambda name: F.lit(False) if mistyped is None else F.exists(mistyped, lambda e: e.startswith(f"{name} must be"))
    return [F.when(value.isNull() & ~known(name), F.lit(f"missing {name}")) for name, value in fields.items()]


def _one_of(name: str, value: Column, allowed: Sequence[str]) -> list[Column]:
    listed = " or ".join(allowed)
    return [
        F.when(value.isNull(), F.lit(f"missing {name}")).when(
            ~value.isin(*allowed), F.concat(F.lit(f"{name} must be {listed}: "), value)
        )
    ]


def _collected(rules: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*rules))


def workload_errors(w: Column, api_versions: Sequence[str] = API_VERSIONS, types: Sequence[str] = APPLICATION_TYPES) -> Column:
    """``array<string>`` of broken rules of a parsed workload; empty when valid."""
    app, res = w["application"], w["resources"]
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    pipeline = app["type"] == "spark-declarative-pipeline"
    rules = _collected(
        _one_of("apiVersion", w["apiVersion"], api_versions)
        + _one_of("kind", w["kind"], ["SparkWorkload"])
        + _required(
            {
                "metadata.name": w["metadata"]["name"],
                "metadata.version": w["metadata"]["version"],
                "runtime.spark": w["runtime"]["spark"],
            }
        )
        + _one_of("application.type", app["type"], types)
        + [
            F.when(pipeline & empty(app["pipelineSpec"]), F.lit(M.PIPELINE_NEEDS_SPEC)),
            F.when(
                app["type"].isin(*types) & ~pipeline & (empty(app["artifact"]) | empty(app["entryPoint"])),
                M.say(M.BUILD_NEEDS_ENTRY, type=app["type"]),
            ),
            F.when(~w["hasDatasets"], F.lit("missing datasets")),
        ]
        + _required(
            {
                "resources.driver.cores": res["driver"]["cores"],
                "resources.driver.memory": res["driver"]["memory"],
                "resources.executor.cores": res["executor"]["cores"],
                "resources.executor.memory": res["executor"]["memory"],
                "resources.scaling.minExecutors": res["scaling"]["minExecutors"],
                "resources.scaling.maxExecutors": res["scaling"]["maxExecutors"],
                "execution.timeout": w["execution"]["timeout"],
            },
            w["typeErrors"],
        )
    )
    return F.concat(rules, w["typeErrors"])


def _binding_errors(bindings: Column, rule) -> Column:
    entries = F.map_entries(F.coalesce(bindings, F.create_map().cast("map<string,struct<kind:string,uri:string,identifier:string>>")))
    return F.array_compact(F.transform(entries, rule))


def dataset_errors(d: Column) -> Column:
    def rule(e: Column) -> Column:
        kind, where = e["value"]["kind"], F.concat(F.lit("bindings."), e["key"])
        return (
            F.when(~F.coalesce(kind.isin(*BINDING_KINDS), F.lit(False)), F.concat(where, F.lit(": kind must be path or table")))
            .when((kind == "path") & e["value"]["uri"].isNull(), F.concat(where, F.lit(": missing uri")))
            .when((kind == "table") & e["value"]["identifier"].isNull(), F.concat(where, F.lit(": missing identifier")))
        )

    head = _collected(
        _one_of("apiVersion", d["apiVersion"], API_VERSIONS)
        + _one_of("kind", d["kind"], ["Dataset"])
        + _required({"metadata.name": d["metadata"]["name"], "bindings": d["bindings"]})
    )
    return F.concat(head, _binding_errors(d["bindings"], rule))


def environment_errors(e: Column) -> Column:
    return _collected(
        _one_of("apiVersion", e["apiVersion"], API_VERSIONS)
        + _one_of("kind", e["kind"], ["Environment"])
        + _required({"metadata.name": e["metadata"]["name"]})
        + _one_of("execution.provider", e["execution"]["provider"], EXECUTION_PROVIDERS)
        + _required({"execution.profile": e["execution"]["profile"]})
        + _one_of("data.provider", e["data"]["provider"], DATA_PROVIDERS)
        + _required({"data.profile": e["data"]["profile"]})
    )


def artifact_errors(a: Column) -> Column:
    def rule(e: Column) -> Column:
        where = F.concat(F.lit("bindings."), e["key"])
        return F.when(
            F.coalesce(e["value"]["kind"], F.lit("path")) != "path", F.concat(where, F.lit(": kind must be path"))
        ).when(e["value"]["uri"].isNull(), F.concat(where, F.lit(": missing uri")))

    head = _collected(
        _one_of("apiVersion", a["apiVersion"], API_VERSIONS)
        + _one_of("kind", a["kind"], ["Artifact"])
        + _required(
            {
                "metadata.name": a["metadata"]["name"],
                "metadata.version": a["metadata"]["version"],
                "bindings": a["bindings"],
            }
        )
    )
    entries = F.coalesce(a["bindings"], F.create_map().cast("map<string,struct<kind:string,uri:string>>"))
    return F.concat(head, F.array_compact(F.transform(F.map_entries(entries), rule)))


def deprecated_version(api_version: Column) -> Column:
    return api_version == DEPRECATED_VERSION


def language_of(application_type: Column) -> Column:
    return F.when(application_type == "jvm-jar", "jvm").otherwise("python")


def override_counts(overrides: Column) -> Column:
    """map provider -> number of override entries; an empty namespace keeps its 0."""
    return F.transform_values(overrides, lambda _, entries: F.coalesce(F.size(F.map_keys(entries)), F.lit(0)))


def portability_status(overrides: Column) -> Column:
    degraded = F.exists(F.map_values(override_counts(overrides)), lambda n: n > 0)
    return F.when(degraded, "PORTABLE_WITH_OVERRIDES").otherwise("PORTABLE")


def capability_errors(
    spark_version: Column, application_type: Column, requirements: Column, capability: Column
) -> Column:
    """Ordered ``array<string>``: what the workload needs and the provider's capability struct lacks."""
    language = language_of(application_type)
    rules = [
        F.when(
            ~F.coalesce(F.array_contains(capability["spark_versions"], spark_version), F.lit(False)),
            M.say(M.UNSUPPORTED_SPARK, version=spark_version),
        ),
        F.when(
            ~F.coalesce(F.array_contains(capability["languages"], language), F.lit(False)),
            M.say(M.UNSUPPORTED_LANGUAGE, language=language),
        ),
    ]
    for need, (offer, label) in REQUIREMENTS.items():
        rules.append(
            F.when(
                requirements[need] & ~F.coalesce(capability[offer], F.lit(False)),
                M.say(M.UNSUPPORTED_FEATURE, feature=F.lit(label)),
            )
        )
    return _collected(rules)


def runtime_version(spark_version: Column, override: Column, curated: Mapping[str, str] = CURATED_RUNTIMES) -> Column:
    """The curated runtime key, else the override, else NULL. An override never hides a curated key."""
    entries = F.create_map(*[F.lit(x) for pair in curated.items() for x in pair])
    return F.coalesce(entries[spark_version], override)


def role_rank(role: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])[role]


def authorized(groups: Column, required_role: Column, grants: Mapping[str, str]) -> Column:
    """Does any group of the caller map to a role of at least the required rank? No mapped group: no."""
    unknown = sorted(set(grants.values()) - set(ROLES))
    if unknown:
        raise ValueError(f"unknown roles in grants: {unknown}")
    role = F.create_map(*[F.lit(x) for pair in grants.items() for x in pair])
    ranks = F.transform(groups, lambda g: role_rank(role[g]))
    return F.coalesce(F.array_max(ranks) >= role_rank(required_role), F.lit(False))
