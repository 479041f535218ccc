"""The two example jobs as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from concord.functions.text import amount, amount_band, normalize_name, words


def tokenize(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per word. Empty pieces are dropped after the explode, inside generated code."""
    return lines.select(F.explode(words(F.col(column))).alias("word")).filter(F.col("word") != "")


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """``word, count``, most frequent first; equal counts by word. Counted per task before the shuffle."""
    counts = tokenize(lines, column).groupBy("word").count()
    return counts.orderBy(F.col("count").desc(), "word")


def join_and_normalize(
    facts: DataFrame,
    reference: DataFrame,
    key: str = "provider_id",
    name: str = "provider_name",
    value: str = "amount",
    keep: Sequence[str] = ("claim_id",),
    extra: Sequence[str] = ("specialty",),
    tail: Sequence[str] = ("service_date",),
    strict: bool = False,
) -> DataFrame:
    """Left join on ``key`` with cleaned name, numeric amount, match flag and amount band.

    Unmatched facts stay. The flag follows the reference name: a match without a name reads as unmatched.
    The join is left to adaptive execution: broadcast if the reference is measured small, otherwise a
    sort-merge join whose hot keys are split.
    """
    joined = facts.join(reference.select(key, name, *extra), key, "left")
    number = amount(F.col(value), strict)
    return joined.select(
        *keep,
        key,
        normalize_name(F.col(name)).alias(name),
        *extra,
        number.alias(value),
        *tail,
        F.col(name).isNotNull().alias("provider_matched"),
        amount_band(number).alias("amount_band"),
    )
