"""Sharding by a k-d tree over document metadata.

The tree has as many leaves as shards. A node with several leaves is cut along the metadata dimension in which its
documents spread widest (as a part of the whole table's spread), at the weighted median that gives each side its share
of the bytes, until every node is a leaf of about the target size. Medians are exact and distributed: bytes are summed
in ``BUCKETS`` buckets of a node's range, the bucket that holds the median becomes the next range, and so on down to one
document; equal values are ordered by a hash of the id, equal ids by row. All nodes of a level are searched at once. The
driver keeps one row per node, hence at most as many as there are shards.

Slots number a shard's documents without gaps: positions within blocks of a bounded number of rows, plus the sum of the
blocks before. No step gathers a shard, a hot value or a group of copies in one task.

A text dimension is the rank of its value among the distinct ones: they are sorted in ranges, each range is numbered by
itself and starts behind the values of the ranges before it; the ranks are joined back.

Null metadata count as zero or as an empty string, null texts as empty (one byte, checksum of nothing). Rows without an
id and repeated rows are documents like any other. An empty table gives an empty result, and with fewer documents than
shards some shards stay empty. Columns that are not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.llm.base import written

SHARDS = 16
BUCKETS = 1024
BLOCK_ROWS = 50_000
PREFIX_BYTES = 7
TIE_BITS = 62
#: Bits of the place within a partition in Spark's increasing ids.
PLACE_BITS = 33
KEY, TIE, ROW = 0, 1, 2


def number(col: Column) -> Column:
    """A numeric dimension as a whole number."""
    return F.coalesce(col.cast("bigint"), F.lit(0).cast("bigint"))


def prefix(col: Column) -> Column:
    """A text dimension as a number in the order of its first bytes; ``Text`` tells values apart that share them."""
    head = F.rpad(F.left(F.hex(F.coalesce(col, F.lit(""))), F.lit(2 * PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
    return F.conv(head, 16, 10).cast("bigint")


@dataclass(frozen=True)
class Text:
    """A text dimension by the order of its whole values."""

    value: Column


@dataclass
class Node:
    """A node under search: it starts at shard ``first`` and has ``leaves`` shards, ``left`` of them left of the cut."""

    first: int
    leaves: int
    goal: float  # bytes that should go left
    dim: int
    low: int
    high: int
    stage: int = KEY
    before: int = 0  # bytes before the range
    found: tuple = ()  # values of the stages that are settled
    inclusive: bool = False
    done: bool = False

    @property
    def left(self) -> int:
        return (self.leaves + 1) // 2

    def search_row(self) -> tuple:
        key, tie = (*self.found, None, None)[:2]
        return self.first, self.dim, self.stage, key, tie, self.low, self.high, (self.high - self.low) // BUCKETS + 1, self.goal - self.before

    def settle(self, low: int, high: int, before: int, weight: int, rows: int, last_row: int) -> None:
        """Takes the bucket that holds the median: its smallest and largest value, bytes before and in it, rows."""
        self.before += before
        self.low, self.high = low, high
        if low < high:
            return
        self.found = (*self.found, low)
        if rows == 1 or self.stage == ROW:
            self.done = True
            self.inclusive = self.before + weight - self.goal <= self.goal - self.before
        else:
            self.stage += 1
            self.low, self.high = 0, (1 << TIE_BITS) if self.stage == TIE else last_row


def _narrow(docs: DataFrame, dims: list[Column | Text]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"key{k}" for k in range(len(dims))]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.coalesce(d.value, F.lit("")).alias(n) if isinstance(d, Text) else d.alias(n) for d, n in zip(dims, names, strict=True)],
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - TIE_BITS).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        F.lit(0).alias("node"),
    )
    columns = rows.columns
    for n, d in zip(names, dims, strict=True):
        if isinstance(d, Text):
            ranks = _ranks(docs.select(F.coalesce(d.value, F.lit("")).alias(n)), n)
            rows = rows.join(ranks, n).drop(n).withColumnRenamed("rank", n).select(*columns)
    return rows


def _ranks(values: DataFrame, name: str) -> DataFrame:
    """``name``, ``rank``: the distinct values of a column and how many are smaller."""
    ordered = values.distinct().repartitionByRange(name).sortWithinPartitions(name)
    # the high bits of these numbers are the range, the low ones the place in it
    placed = written(ordered.withColumn("at", F.monotonically_increasing_id()), "kd-values")
    part = F.shiftright("at", PLACE_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # a row per range
    start = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = counts.select("part", start.alias("start"))
    place = F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(starts, part == F.col("part")).select(name, (F.col("start") + place).alias("rank"))


SEARCH = "node int, dim int, stage int, at_key bigint, at_tie bigint, low bigint, high bigint, width bigint, goal double"


def _medians(rows: DataFrame, keys: list[str], nodes: dict[int, Node], last_row: int) -> None:
    """Settles the cut of every node."""
    spark = rows.sparkSession
    while open_nodes := [n for n in nodes.values() if not n.done]:
        search = spark.createDataFrame([n.search_row() for n in open_nodes], SEARCH)
        key = F.get(F.array(*keys), F.col("dim"))
        value = F.when(F.col("stage") == KEY, key).when(F.col("stage") == TIE, F.col("tie")).otherwise(F.col("row"))
        settled = (F.col("at_key").isNull() | (F.col("at_key") == key)) & (
            F.col("at_tie").isNull() | (F.col("at_tie") == F.col("tie"))
        )
        buckets = (
            rows.join(search, "node")
            .withColumn("value", value)
            .where(settled & F.col("value").between(F.col("low"), F.col("high")))
            .groupBy("node", "goal", F.expr("(value - low) div width").alias("bucket"))
            .agg(
                F.sum("size").alias("weight"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n")
            )
        )
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy("bucket"))
        reached = buckets.withColumn("upto", upto).where(F.col("upto") >= F.col("goal"))
        best = reached.groupBy("node").agg(F.min(F.struct("bucket", "min", "max", "upto", "weight", "n")).alias("b"))
        for r in best.select("node", "b.*").collect():
            nodes[r.node].settle(r.min, r.max, r.upto - r.weight, r.weight, r.n, last_row)


def assign(docs: DataFrame, dims: list[Column | Text], shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, row, node (the shard) of each row of ``docs``."""
    rows = written(_narrow(docs, dims), "kd-rows")
    keys = [f"key{k}" for k in range(len(dims))]
    spread = [F.max(k).alias(f"max_{k}") for k in keys] + [F.min(k).alias(f"min_{k}") for k in keys]
    whole, leaves = None, {0: shards}
    while any(n > 1 for n in leaves.values()):
        spans = rows.groupBy("node").agg(F.sum("size").alias("weight"), F.max("row").alias("last"), *spread).collect()
        if whole is None:
            if not spans:
                break
            whole = [max(spans[0][f"max_{k}"] - spans[0][f"min_{k}"], 1) for k in keys]
        nodes = {}
        for s in spans:
            if (n := leaves[s.node]) > 1:
                widths = [(s[f"max_{k}"] - s[f"min_{k}"]) / w for k, w in zip(keys, whole, strict=True)]
                dim = widths.index(max(widths))
                goal = s.weight * ((n + 1) // 2) / n
                nodes[s.node] = Node(s.node, n, goal, dim, s[f"min_{keys[dim]}"], s[f"max_{keys[dim]}"])
        _medians(rows, keys, nodes, max(s["last"] for s in spans))
        rows = written(_cut(rows, keys, list(nodes.values())), "kd-rows")
        for first, n in list(leaves.items()):
            if n > 1:
                leaves[first], leaves[first + (n + 1) // 2] = (n + 1) // 2, n // 2
    return rows


def _cut(rows: DataFrame, keys: list[str], nodes: list[Node]) -> DataFrame:
    """``rows`` with the node of the next level."""
    cuts = rows.sparkSession.createDataFrame(
        [(n.first, n.dim, *(*n.found, None, None)[:3], n.inclusive, n.left) for n in nodes],
        "node int, dim int, at_key bigint, at_tie bigint, at_row bigint, inclusive boolean, left int",
    )
    key = F.get(F.array(*keys), F.col("dim"))
    below = F.col("inclusive")  # at the cut itself
    for value, at in ((F.col("row"), "at_row"), (F.col("tie"), "at_tie"), (key, "at_key")):
        below = F.when(F.col(at).isNull() | (value == F.col(at)), below).otherwise(value < F.col(at))
    moved = F.when(F.col("left").isNull() | below, F.col("node")).otherwise(F.col("node") + F.col("left"))
    return rows.join(cuts, "node", "left").withColumn("next", moved).select(
        *[c for c in rows.columns if c != "node"], F.col("next").cast("int").alias("node")
    )


def shard(docs: DataFrame, dims: list[Column | Text], shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: a tree is not grown in place) of each row."""
    rows = assign(docs, dims, shards)
    blocks = rows.count() // BLOCK_ROWS + 1
    placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    sums = placed.groupBy("node", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("node").orderBy("block")) - F.col("n")
    starts = sums.select("node", "block", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("node", "block").orderBy("tie", "row"))
    return (
        placed.withColumn("inside", inside)
        .join(starts, ["node", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("node").alias("shard"),
            (F.col("start") + F.col("inside") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
