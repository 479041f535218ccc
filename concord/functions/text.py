"""Scalar functions of the example jobs and of reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def words(text: Column) -> Column:
    """Lower-cased pieces of a text between white space; the first and last may be empty."""
    return F.split(F.lower(text), r"\s+")


def normalize_name(name: Column) -> Column:
    return F.upper(F.trim(name))


def amount(text: Column, strict: bool = False) -> Column:
    """Text to double. Malformed text gives NULL, or an error with ``strict``."""
    return text.cast("double") if strict else text.try_cast("double")


def amount_band(value: Column) -> Column:
    """high from 1000, medium from 100, low below and for NULL."""
    return F.when(value >= 1000, "high").when(value >= 100, "medium").otherwise("low")


def joined_errors(errors: Column) -> Column:
    return F.array_join(errors, "; ")


def supported_versions(curated: Column, overrides: Column) -> Column:
    """Curated and override versions together, distinct and sorted."""
    return F.array_sort(F.array_union(curated, F.coalesce(overrides, F.array().cast("array<string>"))))
