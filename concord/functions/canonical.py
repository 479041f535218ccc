"""Canonical form of a row: the same bytes for rows that are semantically equal.

Column order, map key order, the sign of zero and the session time zone never change the canonical form;
NULL, '' and 'None' stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T
# first argument of the second row hash
SALT = "second"
_FRACTIONAL = (T.DoubleType, T.FloatType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def canonical(col: Column, dtype: T.DataType, round_floats: int | None = None) -> Column:
    """``col`` in a form that ``to_json`` renders without loss."""
    if isinstance(dtype, _FRACTIONAL):
        return (F.round(col, round_floats) if round_floats is not None else col) + F.lit(0.0).cast(dtype)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.struct(
            canonical(e["key"], dtype.keyType, round_floats).alias("key"),
            canonical(e["value"], dtype.valueType, round_floats).alias("value"),
        )
        return F.array_sort(F.transform(F.map_entries(col), entry))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda e: canonical(e, dtype.elementType, round_floats))
    if isinstance(dtype, T.StructType):
        fields = [canonical(col[f.name], f.dataType, round_floats).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, (T.StringType, T.BooleanType, T.IntegralType)):
        return col
    return col.cast("string")


def _ordered(schema: T.StructType, columns: list[str] | None) -> list[T.StructField]:
    names = sorted(columns if columns is not None else schema.names)
    return [schema[name] for name in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def row_text(schema: T.StructType, columns: list[str] | None = None, round_floats: int | None = None) -> Column:
    """The row as JSON text with sorted keys and explicit NULLs."""
    fields = [canonical(column(f.name), f.dataType, round_floats).alias(f.name) for f in _ordered(schema, columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def row_sha(schema: T.StructType, columns: list[str] | None = None, round_floats: int | None = None) -> Column:
    """SHA-256 of :func:`row_text`."""
    return F.sha2(row_text(schema, columns, round_floats), 256)


def hash_inputs(schema: T.StructType, columns: list[str] | None = None, round_floats: int | None = None) -> list[Column]:
    """Arguments for ``xxhash64`` that keep NULLs apart.

    ``xxhash64`` skips NULLs, so each value is followed by its null flag (whatever the declared nullability,
    which may differ between two copies of the same data). Nested values go in as JSON text because hashing
    an array skips NULL elements as well.
    """
    parts: list[Column] = []
    for field in _ordered(schema, columns):
        value = canonical(column(field.name), field.dataType, round_floats)
        if isinstance(field.dataType, _NESTED):
            value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
            parts.append(value)
            continue
        parts += [value, column(field.name).isNull()]
    return parts


def row_hash128(schema: T.StructType, columns: list[str] | None = None, round_floats: int | None = None) -> Column:
    """32 hex digits from two 64-bit hashes. Much cheaper than :func:`row_sha`: no row text is built."""
    inputs = hash_inputs(schema, columns, round_floats)
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.concat(digits(F.xxhash64(*inputs)), digits(F.xxhash64(F.lit(SALT), *inputs)))

