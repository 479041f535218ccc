"""SimHash near-duplicates by multi-index hashing.

A fingerprint has one bit per position set in more than half the hashes of a text's shingles. The 64 bits are cut into
two segments. Two fingerprints that differ in at most three bits differ in at most one bit in one of the segments, so
each fingerprint probes that segment's table with its own value and the 32 values one bit away; whole distances are
verified on what the tables return. Only distinct fingerprints are indexed and linked: copies meet in an aggregate first.
A segment's value that more than ``HOT_KEY`` fingerprints share is looked up together with a quarter of the other segment, in
the same way: of its two quarters one differs in at most one bit, so each probe has the quarter's value and the 16 next to it.
Components are found by large-star and small-star steps over the links, each written below ``spark.checkpoint.dir``.

Null and empty texts have fingerprint zero and are linked like any other. Rows with a null ``doc_id`` are linked too and
never name a component while a row with an id is in it (else ``component_id`` is null). Repeated rows fall into one
component. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.llm.base import as_row, prepared, unrow, written

BITS = 64
SEGMENTS = 2
MAX_DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints that share a segment's value before the other segment is used to tell them apart.
HOT_KEY = 4096
#: Hashes whose bits are counted at once; bounds the memory of a very long text.
CHUNK = 1 << 16


def shingles(text: str, words: int = SHINGLE_WORDS) -> list[bytes]:
    """Word sequences of a text, A-Z lower-cased, split at ASCII white space; a shorter text is one shingle."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False)))


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of a text."""
    found = shingles(text, words) if text else []
    if not found:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), ">u8", len(found))
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found)).view(">i8")[0])


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t, words) for t in texts.to_pylist()], pa.int64())

    return run(text)


def _segment(fp: Column, k: int) -> Column:
    width = BITS // SEGMENTS
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct bigint values ``fp`` of ``nodes`` that differ in 1 to ``max_distance`` bits."""
    if not 0 <= max_distance < 2 * SEGMENTS:
        raise ValueError(f"balls of radius 1 in {SEGMENTS} segments find distances below {2 * SEGMENTS}")
    width = BITS // SEGMENTS
    segments = F.array(
        *[F.struct(F.lit(k).alias("segment"), _segment(F.col("fp"), k).alias("key")) for k in range(SEGMENTS)]
    )
    index = nodes.select("fp", F.explode(segments).alias("s")).select("s.*", F.col("fp").alias("b"))
    ball = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k).cast("bigint") for k in range(width)])
    probes = (
        nodes.select("fp", F.explode(segments).alias("s"))
        .select("s.segment", "s.key", F.col("fp").alias("a"), F.explode(ball).alias("flip"))
        .select("segment", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "a")
    )
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # a pair that is close in an earlier segment too has been found there
    earlier = reduce(
        lambda x, y: x & y,
        [(F.col("segment") <= k) | (F.bit_count(_segment(differ, k)) > 1) for k in range(SEGMENTS - 1)],
    )
    close = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_distance) & earlier
    # sizes are estimated before the explosions: without the hint a probe table of any size may look fit for a broadcast
    found = lambda probes, index, on: probes.join(index.hint("merge"), on).where(close).select("a", "b")
    hot = written(index.groupBy("segment", "key").count().where(F.col("count") > HOT_KEY).drop("count"), "hot-keys")
    if hot.isEmpty():
        return found(probes, index, ["segment", "key"])
    on, half = ["segment", "key"], width // 2
    quarter = lambda fp, k: F.shiftrightunsigned(
        F.when(F.col("segment") == 0, _segment(fp, 1)).otherwise(_segment(fp, 0)), k * half
    ).bitwiseAND(F.lit((1 << half) - 1))
    quarters = lambda fp: F.explode(F.array(*[F.struct(F.lit(k).alias("place"), quarter(fp, k).alias("value")) for k in range(2)]))
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k).cast("bigint") for k in range(half)])
    hot_index = index.join(hot, on).select(*on, "b", quarters(F.col("b")).alias("q")).select(*on, "b", "q.*")
    hot_probes = (
        probes.join(hot, on)
        .select(*on, "a", quarters(F.col("a")).alias("q"))
        .select(*on, "a", "q.*", F.explode(flips).alias("flip"))
        .select(*on, "a", "place", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    )
    # likewise for a pair that is close in the first quarter too
    once = (F.col("place") == 0) | (F.bit_count(quarter(differ, 0)) > 1)
    among = hot_probes.join(hot_index.hint("merge"), [*on, "place", "value"]).where(close & once).select("a", "b")
    cold = found(probes.join(hot, on, "left_anti"), index.join(hot, on, "left_anti"), on)
    return cold.union(among)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``node``, ``root``: each node of an edge with the smallest node that it is connected with.

    Large-star links a node's greater neighbours to its smallest neighbour, small-star its smaller ones; both keep
    connections and end with one star per component. A round's edges are written and the previous round is read back,
    so lineage stays short. Logarithmically many rounds are enough; more than ``max_rounds`` is an error.
    """

    def star(edges: DataFrame, greater: bool) -> DataFrame:
        both = edges.select("a", "b") if not greater else edges.select("a", "b").union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if greater:
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        rest = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.union(low.select("a", F.col("m").alias("b"))).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        current = written(star(star(current, True), False), "edges")
        if (now := state(current)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(keyed: DataFrame, max_distance: int) -> DataFrame:
    """``fp``, ``first``: each distinct fingerprint of ``keyed`` (fp, key) with the smallest key of its component."""
    nodes = written(keyed.groupBy("fp").agg(F.min("key").alias("key")), "nodes")
    roots = components(links(nodes, max_distance))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "key", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("key").alias("first"))
    return rooted.join(firsts, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    keyed = written(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    # ids before no id, so that a null id is the smallest only where nothing else is
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = _grouped(keyed.select("fp", key.alias("key")), max_distance)
    return keyed.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id")
    )


def deduplicate(docs: DataFrame, max_distance: int = MAX_DISTANCE, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of ``docs``, with all columns: the one with the smallest id, then the smallest hash.

    Rows are told apart by doc_id and a 64-bit hash of all their columns (maps left out, which have no hash), so unlike
    texts under one id are documents of their own and the row that stays does not depend on how tasks run. Rows without
    an id stay only if no row with an id is in their group.
    """
    prepared(docs.sparkSession)
    hashed = [docs[f"`{c}`"] for c, kind in docs.dtypes if "map<" not in kind]
    id_ = docs["doc_id"]
    key = F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(*hashed).alias("hash"))
    keyed = written(docs.select(key.alias("key"), fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    keep = _grouped(keyed, max_distance).select(F.col("first").alias("key")).distinct()
    # copies of a row fall away before the shuffle, which the join then shares
    return unrow(as_row(docs, key=key).dropDuplicates(["key"]).join(keep, "key", "left_semi").select("row"))
