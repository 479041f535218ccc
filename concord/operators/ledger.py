"""Profiles of stored data kept per file, so that a new version costs a scan of its new files only.

A ledger has a row per data file: path, size and modification time, and the sums, minima, maxima and hash sums behind a
profile. The profile of a version is the rows of its files added up. When a version follows another one, rows of files that
are still there in the same size and of the same time are taken over, those of files that have gone are left out, and only
files that are new or were rewritten are read. Comparing two versions reads no data at all.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from concord.operators.compare import joined_parts, merged_parts, profile_detail, profile_parts
from concord.session import scratch

#: What tells one version of a file from another.
FILE = {"file": "_metadata.file_path", "size": "_metadata.file_size", "modified": "_metadata.file_modification_time"}


def ordered_fields(schema: T.StructType) -> list[T.StructField]:
    return sorted(schema.fields, key=lambda f: f.name)


def file_parts(df: DataFrame) -> DataFrame:
    """The parts of a profile of each file that ``df``, a scan of files, has rows of: ``file, size, modified, …``.

    One scan; a task sends a row per file it has read.
    """
    return profile_parts(df, ordered_fields(df.schema), keys={n: F.col(c) for n, c in FILE.items()})


def files(spark: SparkSession, location: str) -> DataFrame:
    """``file, size, modified, path`` of the data files below a location. Lists them, reads none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    return listed.select(*[F.col(c).alias(n) for n, c in FILE.items()], "path")


@dataclass(frozen=True)
class Ledger:
    """Stored parts per file and the schema they belong to."""

    files: DataFrame
    schema: T.StructType

    def profile(self) -> DataFrame:
        """One row as of :func:`~concord.operators.compare.profile_row`, without reading data."""
        fields = ordered_fields(self.schema)
        return joined_parts(merged_parts(self.files), fields)

    def save(self, path: str) -> Ledger:
        self.files.withColumn("schema", F.lit(self.schema.json())).write.parquet(path)
        return load(self.files.sparkSession, path)


def load(spark: SparkSession, path: str) -> Ledger:
    """A saved ledger. Ledgers of data without files are not saved with a schema and cannot be loaded."""
    stored = spark.read.parquet(path)
    row = stored.select("schema").first()
    if row is None:
        raise ValueError(f"the ledger at {path} lists no files")
    return Ledger(stored.drop("schema"), T.StructType.fromJson(json.loads(row["schema"])))


def _escaped(path: str) -> str:
    """A path that is no pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _read(spark: SparkSession, schema: T.StructType, paths: list[str], format: str) -> DataFrame:
    """Some files of a location, with the columns that their folders (``key=value``) stand for."""
    reader = spark.read.format(format).schema(schema)
    root = next((m[1] for p in paths if (m := re.match(r"(.*?)/[^/=]+=[^/]*/", p))), None)
    if root:
        reader = reader.option("basePath", root)
    return reader.load([_escaped(p) for p in paths])


def ledger(
    spark: SparkSession, location: str, previous: Ledger | None = None, path: str | None = None, format: str = "parquet"
) -> Ledger:
    """The ledger of what is stored at ``location`` now, saved at ``path`` (default: the scratch folder).

    With the ledger of an earlier version only files that it does not list, or lists with another size or time, are read;
    if the schema has changed, all are. The driver holds the paths of the files to read, as the scan of them does.
    """
    path = path or scratch(spark, "ledger")
    schema = spark.read.format(format).load(location).schema
    now, same = files(spark, location), list(FILE)
    if previous is not None and previous.schema != schema:
        previous = None
    fresh = now if previous is None else now.join(previous.files, same, "left_anti")
    paths = [r["path"] for r in fresh.select("path").collect()]
    parts = [] if previous is None else [previous.files.join(now, same, "left_semi")]
    if paths:
        found = file_parts(_read(spark, schema, paths, format))
        # files without rows are listed as well, so that they are not read again
        empty = fresh.select(*same).join(found, same, "left")
        counts = {n: F.coalesce(F.col(n), F.lit(0)) for n in found.columns if n == "rows" or n.endswith(("_nulls", "_wide"))}
        parts.append(empty.withColumns(counts))
    if not parts:
        raise FileNotFoundError(f"no data files at {location}")
    return Ledger(reduce(DataFrame.unionByName, parts), schema).save(path)


def changed_files(old: Ledger, new: Ledger) -> DataFrame:
    """``file, change``: files of one ledger only (``removed``, ``added``) or stored anew under the old name (``rewritten``)."""
    side = lambda book, name: book.files.select("file", F.struct("size", "modified").alias(name))
    both = side(old, "was").join(side(new, "is"), "file", "full")
    change: Column = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("rewritten")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select("file", change.alias("change"))


def snapshot_compare(old: Ledger, new: Ledger, rtol: float = 1e-9) -> DataFrame:
    """``ord, check, column, left, right``: the mismatches of two versions, from their ledgers alone."""
    return profile_detail(old.profile(), new.profile(), rtol)
