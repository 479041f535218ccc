"""Per-key ordered scans that split hot keys.

A window partitioned by run id puts a whole run into one task. :func:`scan` keeps that plan for ordinary keys
and cuts every key with more than ``hot_rows`` rows into consecutive slices. Slices are scanned on their own and
joined with a carry: the scan's value at the end of the earlier slices, computed from one partial aggregate per
slice. The carry join reuses the window's partitioning.

Slices are cut by rows: the rows of hot keys are dealt out in ranges of key and order, whatever the types of the
order columns and however their values are spread, and stored with the number of their range. A lost task therefore
reads the slices that the others have read. Keys are counted when the scan is built; without a hot key nothing is
stored and the plan is that of a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from concord.functions.canonical import column
from concord.session import scratch

HOT_ROWS = 2_000_000
# ranges come from a sample, so they are aimed at a quarter of what a slice may have
RANGES_PER_HOT_ROWS = 4
_SLICE = "__slice"


@dataclass(frozen=True)
class Previous:
    """The expression's value on the row before this one; NULL on the first row."""

    value: str


@dataclass(frozen=True)
class First:
    """The value on the key's first row."""

    value: str


@dataclass(frozen=True)
class LastBefore:
    """The latest value among earlier rows for which ``when`` holds; NULL if there is none."""

    value: str
    when: str


@dataclass(frozen=True)
class RunningSum:
    """Sum over this row and all earlier ones."""

    value: str


Spec = Previous | First | LastBefore | RunningSum


def _key_columns(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Keys as never-NULL columns (value and NULL flag), so that joins on them are plain equalities and reuse
    the window's partitioning."""
    columns: dict[str, Column] = {}
    for i, key in enumerate(keys):
        dtype, value = df.schema[key].dataType, F.col(key)
        if isinstance(dtype, T.IntegralType):
            columns[f"__k{i}"] = F.coalesce(value, F.lit(0).cast(dtype))
        else:
            columns[f"__k{i}"] = F.coalesce(value.cast("string"), F.lit(""))
        columns[f"__n{i}"] = value.isNull()
    return columns


def _sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int
) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """(all rows, rows of hot keys or None, key columns); ordinary keys are one slice, numbered -1."""
    columns = _key_columns(df, keys)
    keyed, by = df.withColumns(columns), list(columns)
    hot = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows)
    rows = hot.agg(F.sum("__rows")).first()[0]
    whole = F.lit(-1)
    if not rows:
        return keyed.withColumn(_SLICE, whole), None, by
    path = scratch(df.sparkSession, "hot-keys")
    hot.select(*by).write.parquet(f"{path}/keys")
    hot = df.sparkSession.read.parquet(f"{path}/keys")
    ranges = -(-rows * RANGES_PER_HOT_ROWS // hot_rows)
    heavy = keyed.join(hot, by, "left_semi").repartitionByRange(ranges, *by, *order)
    heavy.withColumn(_SLICE, F.spark_partition_id()).write.parquet(f"{path}/rows")
    heavy = df.sparkSession.read.parquet(f"{path}/rows")
    return keyed.join(hot, by, "left_anti").withColumn(_SLICE, whole).unionByName(heavy), heavy, by


def _boxed(value: str) -> str:
    return f"named_struct('v', {value})"


def _local(spec: Spec, window) -> Column:
    if isinstance(spec, Previous):
        return F.lag(F.expr(_boxed(spec.value))).over(window)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if isinstance(spec, First):
        return F.first(F.expr(_boxed(spec.value))).over(upto)
    if isinstance(spec, LastBefore):
        boxed = F.expr(f"CASE WHEN {spec.when} THEN {_boxed(spec.value)} END")
        return F.last(boxed, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.sum(F.expr(spec.value)).over(upto)


def _slice_end(spec: Spec, order: Sequence[str]) -> Column:
    at = f"struct({', '.join(order)})"
    if isinstance(spec, Previous):
        return F.expr(f"max_by({_boxed(spec.value)}, {at})")
    if isinstance(spec, First):
        return F.expr(f"min_by({_boxed(spec.value)}, {at})")
    if isinstance(spec, LastBefore):
        return F.expr(f"max_by({_boxed(spec.value)}, {at}) FILTER (WHERE {spec.when})")
    return F.sum(F.expr(spec.value))


def _carried(spec: Spec, name: str, before) -> Column:
    end = f"__c_{name}"
    if isinstance(spec, RunningSum):
        return F.sum(end).over(before)
    if isinstance(spec, First):
        return F.first(end, ignorenulls=True).over(before)
    return F.last(end, ignorenulls=True).over(before)


def _combined(spec: Spec, name: str) -> Column:
    local, prior = F.col(f"__l_{name}"), F.col(f"__c_{name}")
    if isinstance(spec, RunningSum):
        return F.coalesce(prior, F.lit(0)) + F.coalesce(local, F.lit(0))
    if isinstance(spec, First):
        return F.coalesce(prior, local)["v"]
    return F.coalesce(local, prior)["v"]


def _alone(spec: Spec, name: str) -> Column:
    local = F.col(f"__l_{name}")
    return F.coalesce(local, F.lit(0)) if isinstance(spec, RunningSum) else local["v"]


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, Spec], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add one column per entry of ``specs``; rows of a key are taken in ``order``, which must be unique.

    A column of ``df`` that has the name of an entry gives way to it; names that begin with two underscores are kept for
    columns of this module. Keys are counted in a narrow scan; hot ones add a stored copy of their rows and a partial aggregate per slice.
    Spec expressions are SQL text over the columns of ``df``.
    """
    sliced, heavy, by = _sliced(df, list(keys), list(order), hot_rows)
    kept = [column(c) for c in df.columns if c not in specs]
    by = [*by, _SLICE]
    if heavy is None:
        window = Window.partitionBy(*by).orderBy(*order)
        scanned = sliced.select("*", *[_local(spec, window).alias(f"__l_{name}") for name, spec in specs.items()])
        return scanned.select(*kept, *[_alone(spec, name).alias(name) for name, spec in specs.items()])
    ends = heavy.groupBy(*by).agg(
        *[_slice_end(spec, order).alias(f"__c_{name}") for name, spec in specs.items()]
    )
    before = Window.partitionBy(*by[:-1]).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, *[_carried(spec, name, before).alias(f"__c_{name}") for name, spec in specs.items()])
    window = Window.partitionBy(*by).orderBy(*order)
    scanned = sliced.select("*", *[_local(spec, window).alias(f"__l_{name}") for name, spec in specs.items()])
    return scanned.join(carry, by, "left").select(
        *kept, *[_combined(spec, name).alias(name) for name, spec in specs.items()]
    )
