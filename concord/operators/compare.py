"""Semantic comparison of datasets.

Each side is reduced to one profile row in a single scan without shuffling rows: schema, row count, null
counts, exact sums, minima, maxima and an order-independent fingerprint. Two profiles decide the verdict; the
row-level operators below it (one shuffle of partial counts for both sides together) say which rows differ.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.functions import messages as M
from concord.functions.canonical import SALT, canonical, column, hash_inputs, quoted, row_hash128, row_sha
from concord.functions.exact import exact_sum, is_narrow, join_limbs, limb_sums, to_micro
from concord.operators import sketch

_COLUMNS = (
    "array<struct<name:string,type:string,numeric:boolean,nulls:bigint,sum:string,min:string,max:string,"
    "wide_rows:bigint,wide_sum:double>>"
)
# aggregation buffers beside the row count and the six of a fingerprint; 100 fields end generated code
MAX_BUFFERS = 88
_CHECK = "struct<ord:int,check:string,column:string,left:string,right:string>"


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from a table's own columns."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


# -- fingerprints ---------------------------------------------------------------------------------------------


def _hashes(schema: T.StructType, columns: list[str] | None, round_floats: int | None) -> tuple[Column, Column]:
    inputs = hash_inputs(schema, columns, round_floats)
    return F.xxhash64(*inputs), F.xxhash64(F.lit(SALT), *inputs)


def _hash_aggregates(prefix: str, first: str, second: str) -> list[Column]:
    return limb_sums(first, f"{prefix}h1") + limb_sums(second, f"{prefix}h2")


def _digest(prefix: str, rows: str) -> str:
    part = [f"CAST(coalesce({join_limbs(prefix + name)}, 0) AS STRING)" for name in ("h1", "h2")]
    return f"concat_ws(':', CAST({rows} AS STRING), {', '.join(part)})"


def fingerprint(
    df: DataFrame, by: Sequence[str] = (), columns: list[str] | None = None, round_floats: int | None = None
) -> DataFrame:
    """Row count and an order-independent, duplicate-aware digest, of the whole dataset or per ``by`` group.

    The digest adds two 64-bit row hashes up exactly, so it is the same under any partitioning, row order or
    column order, and a duplicated row counts twice.
    """
    first, second = _hashes(df.schema, columns, round_floats)
    hashed = df.select(*by, first.alias("h1"), second.alias("h2"))
    grouped = hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *_hash_aggregates("", "h1", "h2")
    )
    return grouped.select(*by, "rows", F.expr(_digest("", "rows")).alias("fingerprint"))


def partition_level_compare(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups of ``by`` whose content differs: ``<by>, left_rows, right_rows`` (0 when the group is absent).

    Where ``by`` has a column of one of these names, the added one gets an underscore.
    """
    sides, keys = [], [f"k{i}" for i in range(len(by))]
    for name, df in (("l", left), ("r", right)):
        first, second = _hashes(df.schema, None, None)
        mine = lambda value, own=name: [value if side == own else F.lit(None).cast("bigint") for side in "lr"]
        (l1, r1), (l2, r2), (ln, rn) = mine(first), mine(second), mine(F.lit(1).cast("bigint"))
        values = {"l_n": ln, "r_n": rn, "l1": l1, "l2": l2, "r1": r1, "r2": r2}
        named = [column(c).alias(k) for c, k in zip(by, keys, strict=True)]
        sides.append(df.select(*named, *[value.alias(n) for n, value in values.items()]))
    grouped = (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*keys)
        .agg(
            F.count("l_n").alias("left_rows"),
            F.count("r_n").alias("right_rows"),
            *_hash_aggregates("l_", "l1", "l2"),
            *_hash_aggregates("r_", "r1", "r2"),
        )
    )
    differs = f"{_digest('l_', 'left_rows')} <> {_digest('r_', 'right_rows')}"
    shown = [F.col(k).alias(c) for k, c in zip(keys, by, strict=True)]
    counts = [F.col(n).alias(free_name(n, by)) for n in ("left_rows", "right_rows")]
    return grouped.filter(differs).select(*shown, *counts)


# -- profiles -------------------------------------------------------------------------------------------------


def schema_entries(schema: T.StructType) -> list[tuple[str, str]]:
    """(name, type) sorted by name; nullability and column order play no part."""
    return sorted((f.name, f.dataType.simpleString()) for f in schema.fields)


def _is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def _is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _column_aggregates(i: int, field: T.StructField) -> list[Column]:
    col = quoted(field.name)
    aggregates = [F.expr(f"count_if({col} IS NULL) AS c{i}_nulls")]
    if _is_integer(field.dataType):
        aggregates += limb_sums(f"CAST({col} AS BIGINT)", f"c{i}_s")
    elif _is_floating(field.dataType):
        number = f"CAST({col} AS DOUBLE)"
        wide = f"CASE WHEN NOT {is_narrow(number)} THEN {number} END"
        aggregates += limb_sums(to_micro(number), f"c{i}_s")
        aggregates += [F.expr(f"count({wide}) AS c{i}_wide"), F.expr(f"sum({wide}) AS c{i}_wide_sum")]
        col = f"({col} + CAST(0 AS {field.dataType.simpleString()}))"  # -0.0 and 0.0 are one value
    else:
        return aggregates
    return aggregates + [F.expr(f"min({col}) AS c{i}_min"), F.expr(f"max({col}) AS c{i}_max")]


def _column_profile(i: int, field: T.StructField) -> str:
    floating = _is_floating(field.dataType)
    numeric = floating or _is_integer(field.dataType)
    total, low, high = (
        (exact_sum(f"c{i}_s", floating), f"c{i}_min", f"c{i}_max") if numeric else ("NULL", "NULL", "NULL")
    )
    wide, wide_sum = (f"c{i}_wide", f"c{i}_wide_sum") if floating else ("0L", "CAST(NULL AS DOUBLE)")
    literal = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return (
        f"named_struct('name', {literal(field.name)}, 'type', {literal(field.dataType.simpleString())}, "
        f"'numeric', {str(numeric).lower()}, 'nulls', c{i}_nulls, 'sum', CAST({total} AS STRING), "
        f"'min', CAST({low} AS STRING), 'max', CAST({high} AS STRING), "
        f"'wide_rows', {wide}, 'wide_sum', {wide_sum})"
    )


def profile_row(df: DataFrame, round_floats: int | None = None, with_fingerprint: bool = True) -> DataFrame:
    """One row: ``rows, columns array<struct>, fingerprint``. One scan, partial aggregation, no row shuffle.

    ``sum`` is exact: whole numbers as they are, floating values in millionths. Values of 9e9 and more,
    infinities and NaN are left out of it and reported as ``wide_rows`` and ``wide_sum``.
    """
    groups = _column_groups(sorted(df.schema.fields, key=lambda f: f.name))
    if len(groups) == 1:
        return _profile(df, groups[0], round_floats, with_fingerprint)
    # each group reads its own columns, so a columnar scan reads every column once for these and once for the hashes
    parts = [_profile(df, group, round_floats, False) for group in groups]
    if with_fingerprint:
        parts.append(_profile(df, [], round_floats, True))
    numbered = [part.withColumn("__part", F.lit(k)) for k, part in enumerate(parts)]
    listed = F.array_sort(F.collect_list(F.struct("__part", "columns")))
    return (
        reduce(DataFrame.unionByName, numbered)
        .agg(F.max("rows").alias("rows"), listed.alias("parts"), F.max("fingerprint").alias("fingerprint"))
        .select("rows", F.flatten("parts.columns").alias("columns"), "fingerprint")
    )


def _column_groups(fields: list[T.StructField]) -> list[list[T.StructField]]:
    """Columns whose aggregates fit one aggregation with generated code (``spark.sql.codegen.maxFields``)."""
    groups: list[list[T.StructField]] = [[]]
    used = 0
    for field in fields:
        buffers = len(_column_aggregates(0, field))
        if groups[-1] and used + buffers > MAX_BUFFERS:
            groups.append([])
            used = 0
        groups[-1].append(field)
        used += buffers
    return groups


def _profile(df: DataFrame, fields: list[T.StructField], round_floats: int | None, with_fingerprint: bool) -> DataFrame:
    return joined_parts(profile_parts(df, fields, round_floats, with_fingerprint), fields, with_fingerprint)


def profile_parts(
    df: DataFrame,
    fields: list[T.StructField],
    round_floats: int | None = None,
    with_fingerprint: bool = True,
    keys: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The sums, minima and maxima behind a profile, of all rows or per ``keys``; :func:`merged_parts` adds them up."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        aggregates += _column_aggregates(i, field)
    named = [c.alias(n) for n, c in (keys or {}).items()]
    if with_fingerprint:
        first, second = _hashes(df.schema, None, round_floats)
        df = df.select(*named, *[column(f.name) for f in fields], first.alias("__h1"), second.alias("__h2"))
        aggregates += _hash_aggregates("", "__h1", "__h2")
    elif named:
        df = df.select(*named, *[column(f.name) for f in fields])
    return df.groupBy(*(keys or ())).agg(*aggregates)


def merged_parts(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parts of disjoint sets of rows as the part of all of them; without any part, that of no rows."""
    counts = lambda name: name == "rows" or name.endswith(("_nulls", "_wide"))
    aggregates = []
    for name in parts.columns:
        if name in keys or not (name == "rows" or re.fullmatch(r"(c\d+_|h[12]_).*", name)):
            continue
        if name.endswith(("_min", "_max")):
            aggregates.append((F.min if name.endswith("_min") else F.max)(name).alias(name))
        else:
            total = F.sum(name)
            aggregates.append((F.coalesce(total, F.lit(0)) if counts(name) else total).alias(name))
    return parts.groupBy(*keys).agg(*aggregates)


def joined_parts(
    parts: DataFrame, fields: list[T.StructField], with_fingerprint: bool = True, keys: Sequence[str] = ()
) -> DataFrame:
    """Profiles ``rows, columns, fingerprint`` from parts."""
    digest = F.expr(_digest("", "rows")) if with_fingerprint else F.lit(None).cast("string")
    profiles = ", ".join(_column_profile(i, f) for i, f in enumerate(fields))
    return parts.select(
        *keys, "rows", F.expr(f"CAST(array({profiles}) AS {_COLUMNS}) AS columns"), digest.alias("fingerprint")
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Long form of :func:`profile_row`: one row per column."""
    return (
        profile_row(df, with_fingerprint=False)
        .select("rows", F.explode("columns").alias("c"))
        .select(
            F.col("c.name").alias("column"),
            F.col("c.type").alias("type"),
            "rows",
            *[F.col(f"c.{name}").alias(name) for name in ("nulls", "sum", "min", "max", "wide_rows")],
        )
    )


# -- schema ---------------------------------------------------------------------------------------------------


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every column name of either side with both types and whether they agree. Metadata only, no scan."""
    mine, theirs = dict(schema_entries(left.schema)), dict(schema_entries(right.schema))
    rows = [(n, mine.get(n), theirs.get(n), mine.get(n) == theirs.get(n)) for n in sorted(mine | theirs)]
    return left.sparkSession.createDataFrame(
        rows, "`column` string, left_type string, right_type string, same boolean"
    )


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted(set(left.columns) & set(right.columns))


# -- row level ------------------------------------------------------------------------------------------------


_ROW_HASHES = {"sha256": row_sha, "xxhash128": row_hash128}


def _hashed(df: DataFrame, columns: list[str] | None, round_floats: int | None, digest: str) -> DataFrame:
    """Row hashes as binary: half the bytes of their digits go through the shuffle."""
    return df.select(F.unhex(_ROW_HASHES[digest](df.schema, columns, round_floats)).alias("row_hash"))


def _digits(name: str, digest: str) -> Column:
    return F.lower(F.hex(name)) if digest == "sha256" else F.hex(name)


def row_hash_counts(
    df: DataFrame, columns: list[str] | None = None, round_floats: int | None = None, digest: str = "sha256"
) -> DataFrame:
    """``row_hash, n``: how often each distinct row occurs."""
    counted = _hashed(df, columns, round_floats, digest).groupBy("row_hash").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("row_hash", _digits("row_hash", digest))


def _side_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    tagged = [
        df.withColumn("__l", F.lit(l).cast("bigint")).withColumn("__r", F.lit(r).cast("bigint"))
        for df, l, r in ((left, 1, 0), (right, 0, 1))
    ]
    return (
        tagged[0]
        .unionByName(tagged[1])
        .groupBy(*keys)
        .agg(F.sum("__l").alias("left_n"), F.sum("__r").alias("right_n"))
    )


def multiset_diff(
    left: DataFrame,
    right: DataFrame,
    columns: list[str] | None = None,
    round_floats: int | None = None,
    digest: str = "xxhash128",
) -> DataFrame:
    """Row hashes that do not occur equally often: ``row_hash, left_n, right_n``.

    Both sides go through one aggregation, so copies of a row are counted before they are shuffled, and only
    the hash of a row is shuffled. ``digest="sha256"`` hashes the canonical row text instead.
    """
    hashed = [_hashed(df, columns, round_floats, digest) for df in (left, right)]
    differing = _side_counts(*hashed, ["row_hash"]).filter(F.col("left_n") != F.col("right_n"))
    return differing.withColumn("row_hash", _digits("row_hash", digest))


def _groupable(df: DataFrame, names: Sequence[str]) -> list[Column]:
    kinds = (T.MapType, T.VariantType)
    form = lambda n, t: canonical(column(n), t) if isinstance(t, kinds) else column(n)
    return [form(n, df.schema[n].dataType) for n in names]


def _same_columns(left: DataFrame, right: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """The columns to compare; an error if a side lacks one or has it in another type."""
    mine, theirs = dict(schema_entries(left.schema)), dict(schema_entries(right.schema))
    names = list(left.columns if columns is None else columns)
    compared = names if columns is not None else [*names, *(c for c in right.columns if c not in mine)]
    differing = [c for c in compared if c not in mine or mine[c] != theirs.get(c)]
    if differing:
        shown = ", ".join(f"{c} ({mine.get(c, 'missing')} / {theirs.get(c, 'missing')})" for c in differing)
        raise ValueError(f"the sides differ in columns, name those to compare: {shown}")
    return names


def row_diff(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    sketch_rows: int = sketch.MOST,
) -> DataFrame:
    """Rows of the multiset difference in both directions with their surplus: ``side, copies, <columns>``.

    Sides that differ in a column or its type are refused unless ``columns`` names what to compare; :func:`schema_diff`
    lists such columns. Where the data have a column ``side`` or ``copies``, the added one gets an underscore.

    The hashes of differing rows come from a sketch (:mod:`~concord.operators.sketch`, one or two jobs when this is called),
    which shuffles no rows; whole rows are read and grouped for these only. Above ``sketch_rows`` differing rows (0: always)
    128-bit row hashes are counted instead. With ``by`` the sides are first compared per group, which shuffles no rows
    either, and the hashes of rows of differing groups are counted. Map and variant columns come out as sorted entries or
    text, the form in which they can be grouped.
    """
    names = _same_columns(left, right, columns)
    if by:
        # the differing groups carry names that no column of the sides has
        own = [free_name(f"by{i}", [*left.columns, *right.columns]) for i in range(len(by))]
        differing = partition_level_compare(left, right, by).select(*[column(c).alias(k) for c, k in zip(by, own, strict=True)])
        same = reduce(Column.__and__, [column(c).eqNullSafe(F.col(k)) for c, k in zip(by, own, strict=True)])
        left, right = (df.join(differing, same, "left_semi") for df in (left, right))
    first, second = _hashes(left.schema, names, None)
    # the columns get numbers for names, which clash with nothing and need no quotes
    plain = [f"c{i}" for i in range(len(names))]
    sides = [
        df.select(first.alias("h1"), second.alias("h2"), *[c.alias(p) for c, p in zip(_groupable(df, names), plain, strict=True)])
        for df in (left, right)
    ]
    hashed = [s.select("h1", "h2") for s in sides]
    found = sketch.difference(*hashed, sketch_rows) if sketch_rows and not by else None
    if found is not None:
        differing = sketch.as_table(left.sparkSession, found, ("h1", "h2", "surplus")).select("h1", "h2")
    else:
        differing = _side_counts(*hashed, ["h1", "h2"]).filter(F.col("left_n") != F.col("right_n")).select("h1", "h2")
    counts = _side_counts(*[s.join(differing, ["h1", "h2"], "left_semi").select(*plain) for s in sides], plain)
    surplus = F.col("left_n") - F.col("right_n")
    return counts.filter(surplus != 0).select(
        F.when(surplus > 0, "left").otherwise("right").alias(free_name("side", names)),
        F.abs(surplus).alias(free_name("copies", names)),
        *[F.col(p).alias(name) for p, name in zip(plain, names, strict=True)],
    )


def partition_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct partition tuples."""
    return df.select(*[column(c) for c in columns]).distinct()


def coverage_diff(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Partition tuples that only one side has: ``<columns>, present_in`` (with an underscore if that is a column)."""
    plain = [f"c{i}" for i in range(len(columns))]
    sides = [df.select(*[column(c).alias(p) for c, p in zip(columns, plain, strict=True)]) for df in (left, right)]
    counts = _side_counts(*sides, plain)
    one_sided = (F.col("left_n") == 0) | (F.col("right_n") == 0)
    side = F.when(F.col("left_n") > 0, "left").otherwise("right")
    shown = [F.col(p).alias(c) for p, c in zip(plain, columns, strict=True)]
    return counts.filter(one_sided).select(*shown, side.alias(free_name("present_in", columns)))


def invariants(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``invariant, violations, unknown``: rows for which a caller's predicate is false, and for which it is NULL.

    All checks share one scan.
    """
    broken = [F.count_if(~check).alias(f"v{i}") for i, check in enumerate(checks.values())]
    unknown = [F.count_if(check.isNull()).alias(f"u{i}") for i, check in enumerate(checks.values())]
    rows = [
        F.struct(F.lit(n).alias("invariant"), F.col(f"v{i}").alias("violations"), F.col(f"u{i}").alias("unknown"))
        for i, n in enumerate(checks)
    ]
    return df.agg(*broken, *unknown).select(F.inline(F.array(*rows)))


# -- verdict --------------------------------------------------------------------------------------------------


def _mismatch(order: int, check: str, name: Column, left: Column, right: Column) -> Column:
    return F.struct(
        F.lit(order).alias("ord"),
        F.lit(check).alias("check"),
        name.alias("column"),
        left.cast("string").alias("left"),
        right.cast("string").alias("right"),
    )


def _one(condition: Column, mismatch: Column) -> Column:
    return F.when(condition, F.array(mismatch)).otherwise(F.array().cast(f"array<{_CHECK}>"))


def _schema_text(columns: Column) -> Column:
    return F.array_join(F.transform(columns, lambda c: F.concat(c["name"], F.lit(":"), c["type"])), ",")


def _wide_differs(l: Column, r: Column, rtol: float) -> Column:
    a, b = F.coalesce(l["wide_sum"], F.lit(0.0)), F.coalesce(r["wide_sum"], F.lit(0.0))
    close = a.eqNullSafe(b) | (F.abs(a - b) <= F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)))
    return (l["wide_rows"] != r["wide_rows"]) | ~close


def profile_mismatches(left: Column, right: Column, rtol: float = 1e-9) -> Column:
    """Ordered mismatches of two :func:`profile_row` structs, in one expression.

    Order: schema, row count, null counts by column name, sum / min / max by column name, row content. Row
    content is only looked at when the schemas agree.
    """
    lc, rc = left["columns"], right["columns"]
    none = F.lit(None).cast("string")
    paired = F.filter(
        F.transform(lc, lambda c: F.struct(c.alias("l"), F.get(F.filter(rc, lambda d: d["name"] == c["name"]), F.lit(0)).alias("r"))),
        lambda p: p["r"].isNotNull(),
    )
    numeric = F.filter(paired, lambda p: p["l"]["numeric"] & p["r"]["numeric"])
    nulls = F.transform(
        F.filter(paired, lambda p: p["l"]["nulls"] != p["r"]["nulls"]),
        lambda p: _mismatch(3, "null_count", p["l"]["name"], p["l"]["nulls"], p["r"]["nulls"]),
    )

    def aggregates(p: Column) -> Column:
        found = []
        for name in ("sum", "min", "max"):
            differs = ~p["l"][name].eqNullSafe(p["r"][name])
            if name == "sum":
                differs = differs | _wide_differs(p["l"], p["r"], rtol)
            found.append(
                F.when(differs, _mismatch(4, name, p["l"]["name"], p["l"][name], p["r"][name]))
            )
        return F.array_compact(F.array(*found))

    same_schema = _schema_text(lc) == _schema_text(rc)
    return F.concat(
        _one(~same_schema, _mismatch(1, "schema", none, _schema_text(lc), _schema_text(rc))),
        _one(left["rows"] != right["rows"], _mismatch(2, "row_count", none, left["rows"], right["rows"])),
        nulls.cast(f"array<{_CHECK}>"),
        F.flatten(F.transform(numeric, aggregates)).cast(f"array<{_CHECK}>"),
        _one(
            same_schema & (left["fingerprint"] != right["fingerprint"]),
            _mismatch(6, "row_content", none, left["fingerprint"], right["fingerprint"]),
        ),
    )


_TEXTS = {
    "schema": M.SCHEMA,
    "row_count": M.ROW_COUNT,
    "null_count": M.NULL_COUNT,
    "partition_coverage": M.COVERAGE,
    "invariant": M.INVARIANT,
    "row_content": M.ROW_CONTENT,
}


def mismatch_text(mismatch: Column) -> Column:
    """One line per mismatch for reports."""
    shown = lambda name: F.coalesce(mismatch[name], F.lit("NULL"))
    parts = {name: shown(name) for name in ("check", "column", "left", "right")}
    text = M.say(M.AGGREGATE, **parts)
    for check, template in _TEXTS.items():
        text = F.when(mismatch["check"] == check, M.say(template, **parts)).otherwise(text)
    return text


def _missing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def profile_detail(left: DataFrame, right: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """``ord, check, column, left, right``: the mismatches of two tables of one profile row."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), F.struct("*").alias("p"))
    pick = lambda name: F.any_value(F.when(F.col("side") == name, F.col("p")), F.lit(True)).alias(name)
    pair = side(left, "l").unionByName(side(right, "r")).agg(pick("l"), pick("r"))
    return pair.select(F.inline(profile_mismatches(F.col("l"), F.col("r"), rtol)))


def compare_detail(
    left: DataFrame,
    right: DataFrame,
    partition_columns: Sequence[str] | None = None,
    checks: Mapping[str, Column] | None = None,
    round_floats: int | None = None,
    rtol: float = 1e-9,
) -> DataFrame:
    """Long form of the comparison: ``ord, check, column, left, right``, one row per mismatch."""
    detail = profile_detail(profile_row(left, round_floats), profile_row(right, round_floats), rtol)
    extra: list[DataFrame] = []
    if partition_columns:
        extra.append(_coverage_mismatch(left, right, partition_columns))
    for side, df in (("left", left), ("right", right)) if checks else ():
        broken = invariants(df, checks).filter("violations > 0")
        sides = {s: (F.col("violations").cast("string") if s == side else F.lit(None).cast("string")) for s in ("left", "right")}
        extra.append(
            broken.select(
                F.lit(7).alias("ord"),
                F.lit("invariant").alias("check"),
                F.col("invariant").alias("column"),
                sides["left"].alias("left"),
                sides["right"].alias("right"),
            )
        )
    return reduce(DataFrame.unionByName, extra, detail)


def _coverage_mismatch(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    label = ",".join(columns)
    missing = [_missing(df, columns) for df in (left, right)]
    if any(missing):
        rows = [(5, "partition_coverage", label, *[("missing " + ",".join(m)) if m else "present" for m in missing])]
        return left.sparkSession.createDataFrame(
            rows, "ord int, check string, `column` string, left string, right string"
        )
    diff = coverage_diff(left, right, columns)
    only = lambda side: F.count_if(F.col(free_name("present_in", columns)) == side)
    return (
        diff.agg(only("left").alias("l"), only("right").alias("r"))
        .filter("l + r > 0")
        .select(
            F.lit(5).alias("ord"),
            F.lit("partition_coverage").alias("check"),
            F.lit(label).alias("column"),
            F.concat(F.col("l"), F.lit(" only here")).alias("left"),
            F.concat(F.col("r"), F.lit(" only here")).alias("right"),
        )
    )


def compare_tables(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """One row: ``matched boolean, mismatches array<string>``. Options as in :func:`compare_detail`."""
    detail = compare_detail(left, right, **options)
    within = F.array_position(F.lit(["sum", "min", "max"]), F.col("check"))
    order = F.struct("ord", F.coalesce("column", F.lit("")), within.alias("within"))
    listed = detail.select(F.struct(order.alias("o"), mismatch_text(F.struct("*")).alias("text")).alias("m"))
    return listed.agg(F.array_sort(F.collect_list("m")).alias("ms")).select(
        (F.size("ms") == 0).alias("matched"), F.transform("ms", lambda m: m["text"]).alias("mismatches")
    )


def gate(report: DataFrame, status: Column | str, kind: str = "compare") -> DataFrame:
    """Fold a report to ``passed``: a comparison needs every row PASS, a certification only no FAIL, a
    validation every row valid."""
    status = F.col(status) if isinstance(status, str) else status
    rule = {"compare": status == "PASS", "certification": status != "FAIL", "validation": status}[kind]
    return report.agg(F.coalesce(F.bool_and(F.coalesce(rule, F.lit(False))), F.lit(True)).alias("passed"))
