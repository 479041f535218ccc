"""Logical names to physical locations, as joins with the binding tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concord.functions import messages as M
from concord.functions.uri import dataset_key, parse_artifact

DEFAULT_CATALOG = "lakehouse"
# What registers an Iceberg REST catalog with a Spark session.
CATALOG_CONFIG = {
    "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions",
    "{root}": "org.apache.iceberg.spark.SparkCatalog",
    "{root}.type": "rest",
    "{root}.client.region": "us-east-1",
}
# Optional profile column -> configuration key below the catalog. Credentials stay out of result tables.
OPTIONAL_CATALOG_CONFIG = {"s3_endpoint": "s3.endpoint", "s3_path_style_access": "s3.path-style-access"}


def dataset_refs(definitions: DataFrame, definition: str = "definition", keep: tuple[str, ...] = ("name", "version")) -> DataFrame:
    """One row per declared input and output, inputs first, duplicates kept: ``direction, ref, dataset``."""
    w = F.col(definition)
    tag = lambda side: F.transform(
        w[side + "s"], lambda r: F.struct(F.lit(side).alias("direction"), r["name"].alias("ref"), r["dataset"].alias("dataset"))
    )
    return definitions.select(*keep, F.inline(F.concat(tag("input"), tag("output"))))


def resolve_datasets(
    refs: DataFrame, bindings: DataFrame, catalog: str = DEFAULT_CATALOG, environment: str = "environment_name"
) -> DataFrame:
    """Add ``kind, config_key, config_value, error`` to (dataset, environment) references.

    ``bindings``: ``dataset_name, environment_name, kind, uri``, unique per (dataset, environment).
    """
    # a row per dataset with all its bindings answers both questions, is the dataset known and is it bound here
    bound = bindings.groupBy(F.col("dataset_name").alias("__dataset")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("environment_name").alias("environment"), "kind", "uri"))).alias("__bound")
    )
    here = F.get(F.filter("__bound", lambda b: b["environment"] == F.col(environment)), F.lit(0))
    found = refs.join(bound, F.col("dataset") == F.col("__dataset"), "left").withColumn("__here", here)
    kind, uri = F.col("__here.kind"), F.col("__here.uri")
    located = F.when(kind == "table", F.concat(F.lit(f"{catalog}."), uri)).otherwise(uri)
    error = F.when(F.col("__bound").isNull(), M.say(M.UNKNOWN_DATASET, dataset=F.col("dataset"))).when(
        uri.isNull(), M.say(M.UNBOUND_DATASET, dataset=F.col("dataset"), environment=F.col(environment))
    )
    return found.select(
        *refs.columns,
        kind.alias("kind"),
        F.when(uri.isNotNull(), dataset_key(F.col("dataset"), kind)).alias("config_key"),
        located.alias("config_value"),
        error.alias("error"),
    )


def resolve_artifacts(
    refs: DataFrame, bindings: DataFrame, reference: str = "reference", environment: str = "environment_name"
) -> DataFrame:
    """Add ``resolved, error``. References without ``artifact://`` pass through; a NULL reference is an error.

    ``bindings``: ``artifact_name, artifact_version, environment_name, uri``.
    """
    parsed = refs.withColumn("__p", parse_artifact(F.col(reference)))
    logical = F.col(reference).startswith("artifact://")
    bound = bindings.select(
        F.col("artifact_name").alias("__name"),
        F.col("artifact_version").alias("__version"),
        F.col("environment_name").alias("__env"),
        F.col("uri").alias("__uri"),
    )
    on = (
        (F.col("__p.name") == F.col("__name"))
        & (F.col("__p.version") == F.col("__version"))
        & (F.col(environment) == F.col("__env"))
    )
    missing = M.say(
        M.UNBOUND_ARTIFACT, name=F.col("__p.name"), version=F.col("__p.version"), environment=F.col(environment)
    )
    error = F.when(
        F.col(reference).isNull() | logical, F.coalesce(F.col("__p.error"), F.when(F.col("__uri").isNull(), missing))
    )
    return parsed.join(bound, on, "left").select(
        *refs.columns,
        F.when(logical, F.col("__uri")).otherwise(F.col(reference)).alias("resolved"),
        error.alias("error"),
    )


def catalog_requirement(
    resolved: DataFrame,
    profiles: DataFrame,
    workload: tuple[str, ...] = ("name",),
    environment: str = "environment_name",
    catalog: str = DEFAULT_CATALOG,
) -> DataFrame:
    """Catalog configuration rows for workloads that use a table in their environment.

    ``profiles``: ``environment_name, catalog_uri, catalog_warehouse``. One error row if either is missing,
    nothing for workloads with path bindings only. ``config_key, config_value, error``.
    """
    needing = resolved.filter(F.col("kind") == "table").select(*workload, environment).distinct()
    joined = needing.join(profiles.withColumnRenamed("environment_name", environment), environment, "left")
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    missing = (text("catalog_uri") == "") | (text("catalog_warehouse") == "")
    row = lambda key, value, error=F.lit(None).cast("string"): F.struct(
        key.alias("config_key"), value.cast("string").alias("config_value"), error.alias("error")
    )
    root = f"spark.sql.catalog.{catalog}"
    failed = F.array(
        row(
            F.lit(None).cast("string"),
            F.lit(None),
            F.lit(M.NO_CATALOG),
        )
    )
    fixed = {key.format(root=root): F.lit(value) for key, value in CATALOG_CONFIG.items()}
    from_profile = {
        f"{root}.uri": F.col("catalog_uri"),
        f"{root}.warehouse": F.col("catalog_warehouse"),
        **{f"{root}.{key}": F.col(name) for name, key in OPTIONAL_CATALOG_CONFIG.items() if name in profiles.columns},
    }
    entries = F.filter(
        F.array(*[row(F.lit(key), value) for key, value in {**fixed, **from_profile}.items()]),
        lambda e: e["config_value"].isNotNull(),
    )
    return joined.select(*workload, environment, F.inline(F.when(missing, failed).otherwise(entries)))


def merge_config(layers: DataFrame, scope: tuple[str, ...] = ("scope",)) -> DataFrame:
    """``scope, key, value``: per scope and key the value of the highest ``priority`` layer."""
    return layers.groupBy(*scope, "key").agg(F.max_by("value", "priority").alias("value"))


def merged_maps(*maps: Column) -> Column:
    """The same for map columns on one row: later maps win."""
    entries = F.concat(*[F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps])
    later = lambda acc, e: F.array_append(F.filter(acc, lambda x: x["key"] != e["key"]), e)
    return F.map_from_entries(F.reduce(entries, F.array().cast("array<struct<key:string,value:string>>"), later))
