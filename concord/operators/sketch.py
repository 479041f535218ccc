"""Which rows two datasets do not share, from a sketch of a size that follows the difference instead of the data.

Every row adds its two hashes and a check of both to three cells of a table, those of the right side with a minus sign. Rows
that both sides have cancel out. A cell in which one kind of row is left shows its hashes (the sums divided by the count, if
the check agrees); taking that row out of its other cells lays further ones open, until the table is empty. Sums are exact
whole numbers, so rows may differ by any number of copies.

The first sketch deals the rows out to levels, each with half the rows of the one before, in few cells a level. If every level
can be emptied, it has given the whole difference; otherwise the deeper levels tell how large the difference is, and a second
sketch of that size is made. Both are partial aggregates: what is shuffled is cells, not rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Distinct rows of a difference that a sketch is made for; above it counting hashes moves less.
MOST = 1 << 16
LEVELS = 32
LEVEL_CELLS = 64
SHARE = 1 / 32
#: Cells for each expected row; a table of three cells a row can be emptied with 1.23.
SPARE = 2.0
_LIMB, _WORD = 21, 1 << 64
_CHECK_BITS = 2 * _LIMB
_PLACE = (1 << 31) - 1


def _limbs(value: str, prefix: str, count: int) -> list[str]:
    """Signed sums of 21-bit parts of a bigint; a third part has all that is left, with its sign."""
    sums = []
    for k in range(count):
        part = f"shiftright({value}, {k * _LIMB})" + (f" & {(1 << _LIMB) - 1}L" if k < 2 else "")
        sums.append(f"sum(sign * ({part})) AS {prefix}{k}")
    return sums


_CHECK = "h1 ^ shiftrightunsigned(h2, 17) ^ shiftleft(h2, 23)"
_PLACES = (f"h1 & {_PLACE}L", f"shiftrightunsigned(h1, 32) & {_PLACE}L", f"h2 & {_PLACE}L")
_LEVEL_BITS = f"shiftrightunsigned(h2, 32) & {_PLACE}L"


def _cells(left: DataFrame, right: DataFrame, size: int, levels: bool) -> list:
    """Cells ``level, cell, n, a0..a2, b0..b2, c0, c1, added`` of the sketch of left less right (columns h1, h2)."""
    both = left.select("h1", "h2", F.lit(1).cast("bigint").alias("sign")).unionByName(
        right.select("h1", "h2", F.lit(-1).cast("bigint").alias("sign"))
    )
    if levels:
        both = both.withColumn("bits", F.expr(_LEVEL_BITS))
        for shift in (1, 2, 4, 8, 16):  # fills up the bits below the highest one, so that counting them gives its place
            both = both.withColumn("bits", F.expr(f"bits | shiftrightunsigned(bits, {shift})"))
    level = "31 - bit_count(bits)" if levels else "0"
    cells = ", ".join(f"int({k * size} + ({place}) % {size})" for k, place in enumerate(_PLACES))
    spread = both.selectExpr("sign", "h1", "h2", f"{_CHECK} AS c", f"{level} AS level", f"explode(array({cells})) AS cell")
    sums = ["sum(sign) AS n", *_limbs("h1", "a", 3), *_limbs("h2", "b", 3), *_limbs("c", "c", 2), "count(1) AS added"]
    return spread.groupBy("level", "cell").agg(*[F.expr(s) for s in sums]).collect()  # at most a row per cell


def _signed(value: int) -> int:
    value &= _WORD - 1
    return value - _WORD if value >> 63 else value


def _check(h1: int, h2: int) -> int:
    u2 = h2 & _WORD - 1
    return (h1 ^ u2 >> 17 ^ u2 << 23) & (1 << _CHECK_BITS) - 1


def _own_cells(h1: int, h2: int, size: int) -> tuple[int, int, int]:
    u1 = h1 & _WORD - 1
    return (u1 & _PLACE) % size, size + (u1 >> 32 & _PLACE) % size, 2 * size + (h2 & _PLACE) % size


def peel(cells: Iterable, size: int) -> tuple[dict[tuple[int, int], int], bool]:
    """(hashes -> surplus on the left, whether the table came out empty) of the cells of one level."""
    table = {}
    for r in cells:
        join = lambda *parts: sum(p << k * _LIMB for k, p in enumerate(parts))
        values = [r.n, join(r.a0, r.a1, r.a2), join(r.b0, r.b1, r.b2), join(r.c0, r.c1)]
        if any(values):
            table[r.cell] = values
    found: dict[tuple[int, int], int] = {}
    open_ = list(table)
    while open_:
        cell = open_.pop()
        n, a, b, c = table.get(cell, (0, 0, 0, 0))
        if not n or a % n or b % n or c % n:
            continue
        h1, h2 = a // n, b // n
        if _signed(h1) != h1 or _signed(h2) != h2 or _check(h1, h2) != c // n:
            continue
        places = _own_cells(h1, h2, size)
        if cell not in places:
            continue
        found[h1, h2] = found.get((h1, h2), 0) + n
        for place in places:
            left = [x - y for x, y in zip(table.get(place, (0, 0, 0, 0)), (n, a, b, c), strict=True)]
            if any(left):
                table[place] = left
                open_.append(place)
            else:
                table.pop(place, None)
    return {k: n for k, n in found.items() if n}, not table


def difference(left: DataFrame, right: DataFrame, most: int = MOST) -> dict[tuple[int, int], int] | None:
    """Hashes that do not occur equally often -> surplus on the left; None if there are too many for a sketch.

    Both sides have the columns h1 and h2. Runs one job over them, and a second one if the difference is not small, but has
    at most ``most`` rows and is a small part (``SHARE``) of all rows, so that its cells are fewer than the rows' hashes.
    """
    by_level: dict[int, list] = {}
    rows = 0
    for r in _cells(left, right, LEVEL_CELLS, True):
        by_level.setdefault(r.level, []).append(r)
        rows += r.added / len(_PLACES)
    found: dict[tuple[int, int], int] = {}
    for level in range(LEVELS - 1, -1, -1):
        part, whole = peel(by_level.get(level, ()), LEVEL_CELLS)
        if not whole:
            break
        found |= part
    else:
        return found
    # this level and those before it hold about as much again, doubled for each of them
    expected = max(len(found), LEVEL_CELLS) << (level + 1)
    if expected > 2 * min(most, rows * SHARE):
        return None
    size = int(SPARE * expected / 3) + LEVEL_CELLS
    found, whole = peel(_cells(left, right, size, False), size)
    return found if whole else None


def as_table(spark, found: dict[tuple[int, int], int], names: tuple[str, str, str]) -> DataFrame:
    """The difference as a table whose size is known, so that joins with it are planned by it."""
    columns = [[h1 for h1, _ in found], [h2 for _, h2 in found], list(found.values())]
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}))
