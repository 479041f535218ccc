"""What the operators of this subpackage share: input columns, written intermediates, word helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.session import configure, scratch

#: Rows per Arrow batch. Texts of documents are long, so batches of the default 10,000 rows would not stay small.
BATCH_ROWS = 400


def prepared(spark: SparkSession) -> SparkSession:
    """The settings the operators rely on: UTC, adaptive execution, small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored below ``spark.checkpoint.dir`` and read back: lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which nulls are equal; the result has the keys once, from the left side."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def as_row(df: DataFrame, **derived: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` beside ``derived``, so that no name can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in derived.items()])


def unrow(df: DataFrame) -> DataFrame:
    return df.select("row.*")
