"""Scans, sinks and logical datasets."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from concord.functions.canonical import column
from concord.functions.uri import dataset_key
from concord.operators.lifecycle import absent_rows, full_replace_upsert
from concord.operators.resolve import DEFAULT_CATALOG, resolve_datasets
from concord.session import scratch


def scan_text(spark: SparkSession, uri: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(uri)


def scan_csv(spark: SparkSession, uri: str) -> DataFrame:
    """Columns from the header row, every value text."""
    return spark.read.option("header", True).csv(uri)


def scan_rows(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """A caller's rows. They go in as an Arrow table, whose size the optimizer knows, so that a join with a short list
    does not shuffle the other side."""
    if not isinstance(schema, T.StructType):
        schema = spark.createDataFrame([], schema).schema
    columns = zip(*rows, strict=True) if rows else [() for _ in schema]
    listed = pd.DataFrame({f.name: pd.Series(list(c), dtype=object) for f, c in zip(schema, columns, strict=True)})
    return spark.createDataFrame(listed, schema)


def scan(spark: SparkSession, kind: str, location: str, format: str = "parquet") -> DataFrame:
    """A table by identifier or files by location (``parquet``, ``orc``, ``json``, ``csv``, ``text``)."""
    if kind == "table":
        return spark.table(location)
    if format == "csv":
        return scan_csv(spark, location)
    return spark.read.format(format).load(location)


def sink(df: DataFrame, kind: str, location: str, mode: str = "overwrite", format: str = "parquet") -> None:
    """Write files (``mode``) or create a table; creating an existing table fails."""
    if kind == "table":
        create_table(df, location, format)
        return
    writer = df.write.mode(mode).format(format)
    (writer.option("header", True) if format == "csv" else writer).save(location)


def create_table(df: DataFrame, identifier: str, format: str = "parquet") -> None:
    df.writeTo(identifier).using(format).create()


def portable_config(
    spark: SparkSession, key: str, environ: Mapping[str, str] | None = None, argv: Sequence[str] | None = None
) -> str:
    """A job setting: session configuration, else environment variable, else ``--key=value`` argument."""
    try:
        return spark.conf.get(key)
    except PySparkException:
        variable = (os.environ if environ is None else environ).get(key.upper().replace(".", "_"))
        if variable is not None:
            return variable
        for argument in sys.argv if argv is None else argv:
            name, found, value = argument.partition("=")
            if found and name == f"--{key}":
                return value
        raise


def dataset_location(spark: SparkSession, dataset: str, **fallbacks) -> tuple[str, str]:
    """(kind, location) of a logical dataset from the job's settings."""
    for kind, suffix in (("path", "uri"), ("table", "identifier")):
        try:
            return kind, portable_config(spark, f"spark.portable.dataset.{dataset}.{suffix}", **fallbacks)
        except PySparkException:
            continue
    raise LookupError(f"no location configured for dataset '{dataset}'")


def bound_location(
    spark: SparkSession, dataset: str, environment: str, bindings: DataFrame, catalog: str | None = DEFAULT_CATALOG
) -> tuple[str, str]:
    """(kind, location) of a logical dataset from the binding table.

    Fetches the single resolved row. ``catalog=None`` keeps table identifiers as they are.
    """
    wanted = spark.range(1).select(F.lit(dataset).alias("dataset"), F.lit(environment).alias("environment_name"))
    bound = bindings.filter((F.col("dataset_name") == dataset))
    row = resolve_datasets(wanted, bound, catalog or "").first()
    if row["error"]:
        raise LookupError(row["error"])
    value = row["config_value"]
    return row["kind"], value[1:] if row["kind"] == "table" and not catalog else value


def read_dataset(
    spark: SparkSession,
    dataset: str,
    environment: str,
    bindings: DataFrame,
    format: str = "parquet",
    catalog: str | None = DEFAULT_CATALOG,
) -> DataFrame:
    kind, location = bound_location(spark, dataset, environment, bindings, catalog)
    return scan(spark, kind, location, format)


def write_dataset(
    df: DataFrame,
    dataset: str,
    environment: str,
    bindings: DataFrame,
    mode: str = "overwrite",
    format: str = "parquet",
    catalog: str | None = DEFAULT_CATALOG,
) -> None:
    kind, location = bound_location(df.sparkSession, dataset, environment, bindings, catalog)
    sink(df, kind, location, mode, format)


def dataset_settings(resolved: DataFrame) -> dict[str, str]:
    """The ``spark.portable.dataset.*`` settings of one job from its resolved references.

    They become settings of the caller's session, so they are fetched, however many the job names. Of several errors
    the first in alphabetical order is raised.
    """
    failed = resolved.agg(F.min("error").alias("error")).first()["error"]
    if failed:
        raise LookupError(failed)
    return {r["config_key"]: r["config_value"] for r in resolved.select("config_key", "config_value").distinct().collect()}


_NOISE = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", re.DOTALL)
_TOKEN = re.compile(r"(?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))*|[(),]")
#: What ends a list of relations.
_CLAUSES = set("SELECT WHERE GROUP ORDER HAVING LIMIT UNION EXCEPT INTERSECT WINDOW SORT CLUSTER DISTRIBUTE QUALIFY".split())


def relations(sql: str) -> set[str]:
    """The names that stand where a query names relations (behind FROM, JOIN and commas between them), in lower case.

    Names of common table expressions are left out. Comments and texts are not looked at.
    """
    tokens = _TOKEN.findall(_NOISE.sub(" ", sql))
    own = {t.strip("`").lower() for t, then, paren in zip(tokens, tokens[1:], tokens[2:], strict=False) if (then.upper(), paren) == ("AS", "(")}
    found, wanted, listed, outer = set(), False, False, []
    for token in tokens:
        word = token.upper()
        if token == "(":
            outer.append(listed)
            wanted = listed = False
        elif token == ")":
            wanted, listed = False, outer.pop() if outer else False
        elif token == ",":
            wanted = listed
        elif word in ("FROM", "JOIN"):
            wanted = listed = True
        elif word in _CLAUSES:
            wanted = listed = False
        elif wanted and word != "LATERAL":
            found.add(token.replace("`", "").lower())
            wanted = False
    return found - own


def view_order(views: Mapping[str, str]) -> list[str]:
    """Names of views so that each comes after those it reads; views that need no others keep their order.

    Views that read one another in a circle are an error that names them.
    """
    names = {name.replace("`", "").lower(): name for name in views}
    reads = {name: [names[r] for r in sorted(relations(sql)) if r in names] for name, sql in views.items()}
    try:
        return list(TopologicalSorter(reads).static_order())
    except CycleError as error:
        raise ValueError(f"views read one another: {' -> '.join(reversed(error.args[1]))}") from None


def materialize_views(spark: SparkSession, views: Mapping[str, str], format: str = "parquet") -> list[str]:
    """Compute named views from SQL text, each after those it reads, and store each as a table (full refresh)."""
    order = view_order(views)
    for name in order:
        spark.sql(views[name]).write.mode("overwrite").format(format).saveAsTable(name)
    return order


# -- tables of files that are changed in part --------------------------------------------------------------


def _of_partitions(existing: DataFrame, new: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of the partitions that ``new`` has rows of. Their values are literals, so the scan lists no others.

    The driver holds one row per partition, as it does for the write.
    """
    touched = new.select(*[column(c) for c in partitions]).distinct().collect()
    which = F.lit(False)
    if len(partitions) == 1:
        values = [r[0] for r in touched]
        which = column(partitions[0]).isin([v for v in values if v is not None])
        return existing.where(which | column(partitions[0]).isNull() if None in values else which)
    for row in touched:
        same = F.lit(True)
        for name, value in zip(partitions, row, strict=True):
            same = same & column(name).eqNullSafe(F.lit(value))
        which = which | same
    return existing.where(which)


def upsert_partitions(
    spark: SparkSession, location: str, new: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: Sequence[str],
    format: str = "parquet",
) -> None:
    """Replace the rows of ``location`` that have a key of ``new`` and add the rows with other keys.

    ``location`` is partitioned by columns whose values follow from the key (a hash of it, its date). Only partitions that
    ``new`` has rows of are read and rewritten, by a dynamic partition overwrite of rows that were written to the scratch
    folder first. Of several new rows with one key the last in ``order`` counts.
    """
    existing = spark.read.format(format).load(location)
    # partition values come back in the types that their folder names suggest
    types = {f.name: f.dataType for f in existing.schema}
    new = new.select(*[column(c).cast(types[c]).alias(c) for c in existing.columns])
    replaced, added = full_replace_upsert(new, _of_partitions(existing, new, partitions), keys, order)
    staged = scratch(spark, "upsert")
    replaced.unionByName(added).write.parquet(staged)
    rows = spark.read.schema(existing.schema).parquet(staged)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(format)
    writer.partitionBy(*partitions).save(location)


def register_partitions(
    spark: SparkSession, location: str, new: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: Sequence[str],
    format: str = "parquet",
) -> None:
    """Add the rows of ``new`` whose key ``location`` lacks; nothing is rewritten, and only their partitions are read."""
    existing = spark.read.format(format).load(location)
    types = {f.name: f.dataType for f in existing.schema}
    new = new.select(*[column(c).cast(types[c]).alias(c) for c in existing.columns])
    staged = scratch(spark, "register")
    absent_rows(new, _of_partitions(existing, new, partitions), keys, order).write.parquet(staged)
    rows = spark.read.schema(existing.schema).parquet(staged)
    rows.write.mode("append").format(format).partitionBy(*partitions).save(location)


__all__ = [
    "bound_location",
    "create_table",
    "dataset_key",
    "dataset_location",
    "dataset_settings",
    "materialize_views",
    "portable_config",
    "read_dataset",
    "register_partitions",
    "relations",
    "scan",
    "scan_csv",
    "scan_rows",
    "scan_text",
    "sink",
    "upsert_partitions",
    "view_order",
    "write_dataset",
]
