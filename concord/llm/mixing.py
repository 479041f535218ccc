"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the paths of a tree (by default domain, language, source). A token budget enters at the root and is divided
among a node's children by their weights. A child gets no more than its subtree can give (tokens times epochs); what it
cannot take goes to its siblings by their weights, and only what all of them cannot take goes up to the ancestors'
siblings. Since a subtree's capacity is known before the budget reaches it, one pass down the tree does both.

Each leaf reads its documents in epochs. The order within an epoch is that of a hash of seed, epoch and doc_id; whole
epochs are taken as long as the budget lasts, then a prefix of the next one. It ends before or behind the document in which
the budget ends, whichever is nearer to it (before, if both are as near); a leaf that would get nothing that way gets that
document, so no leaf with a target stays empty and none misses its target by more than a document.

Prefixes are found without sorting a leaf: tokens are summed per bucket of the hash, the bucket in which the budget ends is
known from these sums, and its documents are summed per smaller bucket in the same way, until a bucket is 2^-32 of a leaf.

Null parts of a path form a node of their own, with the same rules. Documents without tokens (null or empty) are taken
with the epoch they stand in. Rows that share a doc_id in a leaf stand at one place in the order and are taken together;
null ids stand together too. Weights that are missing count as one, those of zero or less as zero: such a node gets what
is left when all others are full, nothing else. An empty table gives an empty result. Columns with clashing names are
kept apart from those made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.llm.base import as_row, join_null_safe, prepared, unrow, written

LEVELS = ("domain", "lang", "source")
SEED = 17
MAX_EPOCHS = 2
BUCKET_BITS = 8
BUCKET_ROUNDS = 4
#: A place has this many hex digits of the hash.
ORDER_DIGITS = 15


def tokens(text: Column) -> Column:
    """An estimate without a vocabulary: a token for every four UTF-8 bytes begun."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("bigint")


def place(doc_id: Column, epoch: Column | int, seed: int) -> Column:
    """Where a document stands in an epoch: 60 bits of a hash."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    text = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(ORDER_DIGITS)), 16, 10).cast("bigint")


def _path(levels: int) -> list[str]:
    return [f"level{k}" for k in range(levels)]


def divide(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (parent columns, budget of the parent, weight, capacity, name) with each node's ``target``.

    Children in the order of capacity per weight fill up one after the other; each gets its share by weight of what the
    ones before have left, but no more than its capacity.
    """
    weight = F.col("weight")
    order = Window.partitionBy(*parent).orderBy(
        F.when(weight > 0, F.col("capacity") / weight).asc_nulls_last(), F.col("name").asc_nulls_first()
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    shared = nodes.withColumn("weight_ahead", F.sum("weight").over(ahead)).withColumn(
        "capacity_before", F.coalesce(F.sum("capacity").over(before), F.lit(0))
    )
    level = (F.col("budget") - F.col("capacity_before")) / F.col("weight_ahead")
    # a child is full if the water level over it and those after it reaches its capacity per weight; all before it are
    # full then too. Past the last full child the level stays that of the first child that is not full.
    full = F.when(weight > 0, F.col("capacity") <= level * weight).otherwise(False)
    last = Window.partitionBy(*parent)
    return (
        shared.withColumn("full", full)
        .withColumn("level", F.min(F.when(~F.col("full") & (weight > 0), F.struct("capacity_before", level.alias("level")))).over(last))
        .withColumn("of_weighted", F.sum(F.when(weight > 0, F.col("capacity")).otherwise(0)).over(last))
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("capacity"))
            .when(weight > 0, F.least(F.col("capacity"), F.floor(F.col("level.level") * weight)))
            .otherwise(
                F.greatest(
                    F.lit(0),
                    F.least(
                        F.col("capacity"),
                        F.col("budget") - F.greatest(F.col("of_weighted"), F.col("capacity_before")),
                    ),
                )
            )
            .cast("bigint"),
        )
        .drop("weight_ahead", "capacity_before", "full", "level", "of_weighted")
    )


def budgets(leaves: DataFrame, weights: DataFrame, levels: int, share: float, max_epochs: int) -> DataFrame:
    """Leaves (level0 .. , tokens) with ``target``. ``weights``: path (array of names), weight.

    The budget is ``share`` of all tokens. A weight belongs to the node at its path, among that node's siblings.
    """
    path = _path(levels)
    capacity = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share).cast("bigint").alias("budget"))
    parents = None
    for depth in range(levels):
        known = path[: depth + 1]
        given = (
            weights.where(F.size("path") == depth + 1)
            .select(*[F.col("path")[k].alias(n) for k, n in enumerate(known)], "weight")
            .groupBy(*known)
            .agg(F.max("weight").alias("given"))
        )
        nodes = capacity.groupBy(*known).agg(F.sum("capacity").alias("capacity"))
        nodes = join_null_safe(nodes, given, known, "left").select(
            *known,
            "capacity",
            F.greatest(F.coalesce("given", F.lit(1.0)), F.lit(0.0)).alias("weight"),
            F.col(known[-1]).alias("name"),
        )
        if parents is None:
            nodes = nodes.withColumn("budget", total.scalar())
        else:
            nodes = join_null_safe(nodes, parents.withColumnRenamed("target", "budget"), known[:-1])
        parents = divide(nodes, known[:-1]).select(*known, "target")
    return join_null_safe(leaves, parents, path)


def plan(
    docs: DataFrame, levels: list[Column], weights: DataFrame, share: float, seed: int, max_epochs: int
) -> tuple[DataFrame, DataFrame]:
    """Written tables: documents (doc_id, levels, tokens) and leaves (levels, tokens, target, epochs, end).

    A leaf is taken in whole in each of its ``epochs`` and up to the place ``end`` in the one after.
    """
    path = _path(len(levels))
    narrow = written(
        docs.select(
            "doc_id",
            *[c.cast("string").alias(n) for c, n in zip(levels, path, strict=True)],
            tokens(F.col("text")).alias("tokens"),
        ),
        "mixing-docs",
    )
    leaves = narrow.groupBy(*path).agg(F.sum("tokens").alias("tokens"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(F.lit(max_epochs))
    planned = written(
        budgets(leaves, weights, len(levels), share, max_epochs)
        .withColumn("epochs", whole.cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens")),
        "mixing-leaves",
    )
    cut = planned.where((F.col("epochs") < max_epochs) & (F.col("rest") > 0)).select(*path, "epochs", "rest")
    ends = _ends(narrow, cut, path, seed)
    leaves = join_null_safe(planned, ends, path, "left")
    return narrow, written(
        leaves.select(*path, "tokens", "target", "epochs", F.coalesce("end", F.lit(0).cast("bigint")).alias("end")),
        "mixing-plan",
    )


def _ends(narrow: DataFrame, cut: DataFrame, path: list[str], seed: int) -> DataFrame:
    """The place (exclusive) at which the prefix of each leaf of ``cut`` ends: path, end."""
    at = place(F.col("doc_id"), F.col("epochs"), seed)
    rows = join_null_safe(narrow, cut, path).select(*path, "tokens", "epochs", "rest", at.alias("place"))
    rows = rows.withColumn("left", F.col("rest"))
    for round_ in range(1, BUCKET_ROUNDS + 1):
        bucketed = rows.withColumn("bucket", F.shiftright("place", 4 * ORDER_DIGITS - BUCKET_BITS * round_))
        sums = bucketed.groupBy(*path, "left", "bucket").agg(F.sum("tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy(*path).orderBy("bucket"))  # at most 2^BUCKET_BITS rows
        last = (
            sums.withColumn("before", upto - F.col("tokens"))
            .where("before <= left AND before + tokens > left")
            .select(*path, "bucket", (F.col("left") - F.col("before")).alias("left"))
        )
        rows = join_null_safe(bucketed.drop("left"), last, [*path, "bucket"]).drop("bucket")
        if round_ == 1:
            rows = written(rows, "mixing-cut")  # a small part of the documents, which the other rounds read
    inner = (
        rows.groupBy(*path, "epochs", "rest", "left", "place")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(Window.partitionBy(*path).orderBy("place")))
    )
    crossing = F.min(F.struct("place", "upto", "tokens", "epochs", "rest", "left")).alias("c")
    over, under = F.expr("c.upto - c.left"), F.expr("c.left - (c.upto - c.tokens)")
    nothing = F.expr("c.epochs = 0") & (under == F.col("c.rest"))
    end = F.col("c.place") + ((over < under) | nothing).cast("bigint")
    return inner.where("upto > left").groupBy(*path).agg(crossing).select(*path, end.alias("end"))


def _taken(rows: DataFrame, leaves: DataFrame, levels: list[str], seed: int, max_epochs: int) -> DataFrame:
    """``rows`` (doc_id, level columns and others) once per epoch that takes them, with ``epoch``."""
    inside = F.col("epoch") < F.col("epochs")
    cut = (F.col("epoch") == F.col("epochs")) & (place(F.col("doc_id"), F.col("epoch"), seed) < F.col("end"))
    epochs = F.array(*[F.lit(k) for k in range(max_epochs)])
    joined = join_null_safe(rows, leaves.select(*levels, "epochs", "end"), levels)
    return joined.withColumn("epoch", F.explode(epochs)).where(inside | cut)


def mixed(docs: DataFrame, levels: list[Column], weights: DataFrame, share: float, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, levels joined by ``/``, tokens, epoch: one row per document and epoch that takes it."""
    narrow, leaves = plan(docs, levels, weights, share, seed, max_epochs)
    path = _path(len(levels))
    taken = _taken(narrow, leaves, path, seed, max_epochs)
    return taken.select("doc_id", F.concat_ws("/", *[F.coalesce(c, F.lit("null")) for c in path]).alias("leaf"), "tokens", "epoch")


def sampled(docs: DataFrame, levels: list[Column], weights: DataFrame, share: float, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as epochs take it."""
    prepared(docs.sparkSession)
    _, leaves = plan(docs, levels, weights, share, seed, max_epochs)
    path = _path(len(levels))
    keyed = as_row(docs, doc_id=docs["doc_id"], **{n: c.cast("string") for c, n in zip(levels, path, strict=True)})
    return unrow(_taken(keyed, leaves, path, seed, max_epochs))
