"""Order-independent sums that stay in 64-bit arithmetic.

A bigint sum can overflow and a decimal(38) sum leaves the fast aggregation path. Each value is split into
three limbs of at most 22 bits; the limb sums fit a bigint for up to 2**41 rows and are put together as a
decimal once, after aggregation. Values are SQL text: a profile of a wide table has hundreds of these terms
and parsing one string is much cheaper than building the same tree call by call.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SHIFT = 21
_MASK = (1 << _SHIFT) - 1
MICRO = 1_000_000
# |x| * 10^6 stays below 2^53, so the scaled value is an exact double
WIDE = "9.0e9D"


def limb_sums(value: str, prefix: str) -> list[Column]:
    """Three aggregate columns ``{prefix}_0..2`` for a bigint expression."""
    return [
        F.expr(f"sum(({value}) & {_MASK}L) AS {prefix}_0"),
        F.expr(f"sum(shiftright({value}, {_SHIFT}) & {_MASK}L) AS {prefix}_1"),
        F.expr(f"sum(shiftright({value}, {2 * _SHIFT})) AS {prefix}_2"),
    ]


def join_limbs(prefix: str) -> str:
    """The exact sum as decimal(38,0) from the columns that :func:`limb_sums` made."""
    part = [f"CAST({prefix}_{i} AS DECIMAL(20,0))" for i in range(3)]
    radix = f"CAST({1 << _SHIFT} AS DECIMAL(8,0))"
    upper = f"CAST({part[2]} * {radix} + {part[1]} AS DECIMAL(28,0))"
    return f"CAST({upper} * {radix} + {part[0]} AS DECIMAL(38,0))"


def is_narrow(value: str) -> str:
    return f"(abs({value}) < {WIDE})"


def to_micro(value: str) -> str:
    """A floating value in whole millionths; NULL when it is too wide, infinite or NaN."""
    return f"CASE WHEN {is_narrow(value)} THEN CAST(rint({value} * {MICRO}D) AS BIGINT) END"


def from_micro(total: str) -> str:
    """decimal(38,6) from a sum of millionths."""
    return f"CAST(CAST({total} AS DECIMAL(30,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(38,6))"


def exact_sum(df_prefix: str, floating: bool) -> str:
    """The sum behind ``df_prefix`` as decimal text: millionths for floating columns, whole otherwise."""
    total = join_limbs(df_prefix)
    return from_micro(total) if floating else total
