"""The example jobs end to end: locations from the job's settings, DataFrame work, result written.

A session is passed in, so any launcher can run them: ``normalize_claims(spark)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.operators.jobs import join_and_normalize, word_count
from concord.sources.datasets import dataset_location, scan, scan_csv, scan_text, sink


def normalize_claims(
    spark: SparkSession,
    claims: str = "claims.raw",
    reference: str = "provider.reference",
    output: str = "claims.normalized",
    **fallbacks,
) -> None:
    """Claims and provider CSV to normalised Parquet. Amounts must be numbers, as in a strict cast."""
    find = lambda name: dataset_location(spark, name, **fallbacks)
    tables = [scan_csv(spark, find(name)[1]) for name in (claims, reference)]
    sink(join_and_normalize(*tables, strict=True), *find(output))


def count_words(spark: SparkSession, source: str = "wordcount.raw", output: str = "wordcount.counts", **fallbacks) -> None:
    """Text lines to word counts in Parquet, most frequent first."""
    find = lambda name: dataset_location(spark, name, **fallbacks)
    sink(word_count(scan_text(spark, find(source)[1])), *find(output))


def write_table(spark: SparkSession, rows: DataFrame, dataset: str = "demo.table", **fallbacks) -> None:
    """Create the table a logical dataset is bound to."""
    sink(rows, *dataset_location(spark, dataset, **fallbacks))


def dump_table(spark: SparkSession, dataset: str = "demo.table", output: str = "demo.readback", **fallbacks) -> None:
    """Read a table by its logical name and write its rows as JSON lines."""
    find = lambda name: dataset_location(spark, name, **fallbacks)
    sink(scan(spark, *find(dataset)), *find(output), format="json")
