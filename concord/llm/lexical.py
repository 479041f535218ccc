"""Ranked lexical search by scanning the documents with an automaton of all the items' terms.

A text becomes lower-cased terms with a blank on either side, and so do the terms of the items, so that the automaton finds
whole terms only. The first scan counts documents and terms and how many documents hold each term; the second one counts
each term in each document again, turns the counts into scores and hands them to the items that have the term. A task keeps
the best documents of each item as it goes. There is no index of the documents, and no count of a document is stored.

Items are dealt into blocks of about ``BLOCK_BYTES`` of terms (at least an item), with an automaton and two scans each: what
is broadcast is bounded by that, however many items there are.

Null texts have no terms; a document without terms is not counted. Items without terms find nothing. Rows of ``items`` with
one id are one item with the terms of all of them, null being an id like any other. Repeated documents are ranked each;
between equal scores the smaller id wins, null ids come last. Very long texts are scanned whole. If a table is empty, the
result is. Columns other than ids and texts are never looked at.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from concord.llm.base import ascii_lower, written

BEST = 50
BLOCK_BYTES = 1 << 22
#: Scores (documents times items) that a task holds at once.
SCORES = 1 << 21
#: Parts in which an item's candidates are ranked before they meet.
PARTS = 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_TERM = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _IS_TERM[b] else 0x20 for b in range(256))

# what the first scan counts beside the terms
DOCUMENTS, TERMS = -1, -2


def plain(text: str) -> bytes:
    """A text with A-Z lower-cased and a blank for each character of no term, as UTF-8."""
    return text.encode().translate(_PLAIN)


def n_terms(data: bytes) -> int:
    inside = np.frombuffer(data, np.uint8) != 0x20
    return int(inside[:1].sum() + np.count_nonzero(inside[1:] > inside[:-1]))


class Terms:
    """The automaton of a block of items, and which items have each of its terms."""

    def __init__(self, items: list[list[str]]):
        self.numbers = {t: k for k, t in enumerate(sorted({t for terms in items for t in terms}))}
        self.automaton = ahocorasick.Automaton()
        for term, k in self.numbers.items():
            self.automaton.add_word(f" {term} ", k)
        self.automaton.make_automaton()
        self.n_items = len(items)
        pairs = sorted((self.numbers[t], k) for k, terms in enumerate(items) for t in set(terms))
        self.items = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted([t for t, _ in pairs], np.arange(len(self.numbers) + 1))

    def counts(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the block in a text and how often each stands there."""
        hits = self.automaton.iter(f" {data.decode()} ")
        return np.unique(np.fromiter((k for _, k in hits), np.int64), return_counts=True)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, terms (distinct, sorted) of each item that has any."""
    found = F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(TERM), F.lit(0)))
    pairs = items.select(F.col(item_id).alias("item_id"), found.alias("term"))
    return pairs.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def statistics(docs: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of ``block`` (a broadcast)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = block.value
        held = np.zeros(len(terms.numbers), np.int64)
        documents = total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and (n := n_terms(data := plain(text))):
                    documents, total = documents + 1, total + n
                    held[terms.counts(data)[0]] += 1
        at = np.flatnonzero(held)
        yield pa.record_batch(
            {"term": np.concatenate([[DOCUMENTS, TERMS], at]), "n": np.concatenate([[documents, total], held[at]])}
        )

    rows = docs.select("text").mapInArrow(scan, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counted = {r.term: r.n for r in rows.collect()}  # a row per term of the block
    held = np.array([counted.get(k, 0) for k in range(len(block.value.numbers))], np.int64)
    return counted.get(DOCUMENTS) or 0, counted.get(TERMS) or 0, held


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)


class _Best:
    """The best documents of each item, in order; between equal scores the smaller id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.found, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def offer(self, ids: list, scores: np.ndarray) -> None:
        """``scores``: a row per document, a column per item."""
        for row, item in zip(*map(np.ndarray.tolist, np.nonzero(scores >= self.least)), strict=True):
            found, doc = self.found[item], ids[row]
            entry = (-int(scores[row, item]), doc is None, 0 if doc is None else doc)
            if len(found) < self.k or entry < found[-1]:
                insort(found, entry)
                del found[self.k :]
                if len(found) == self.k:
                    self.least[item] = -found[-1][0]


def candidates(docs: DataFrame, block, k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the ``k`` best documents of each item in each task, and no others."""
    documents, total, held = statistics(docs, block)
    weight = weights(documents, held)
    out = docs.select(F.lit(0).alias("item"), "doc_id", F.lit(0).cast("bigint").alias("score")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = block.value
        best, id_type = _Best(terms.n_items, k), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in (batch.slice(at, rows) for rows in [max(1, SCORES // terms.n_items)] for at in range(0, batch.num_rows, rows)):
                scores = np.zeros((part.num_rows, terms.n_items), np.int64)
                for row, text in enumerate(part.column(1).to_pylist()):
                    if not text or not (n := n_terms(data := plain(text))):
                        continue
                    found, tf = terms.counts(data)
                    m = 100 - 50 + 50 * n * documents // total
                    gain = weight[found] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                    first, size = terms.first[found], terms.first[found + 1] - terms.first[found]
                    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    np.add.at(scores[row], terms.items[at], np.repeat(gain, size))
                best.offer(part.column(0).to_pylist(), scores)
        rows = [(item, None if null else doc, -minus) for item, found in enumerate(best.found) for minus, null, doc in found]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.record_batch(
                [pa.array(item, pa.int32()), pa.array(doc, id_type), pa.array(score, pa.int64())], names=["item", "doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(scan, out)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their rank, first among parts of an item's rows, then among the best of these."""
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    rank = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    some = found.withColumn("part", part).withColumn("rank", rank).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item, scores above 0."""
    spark = docs.sparkSession
    terms = written(item_terms(items), "search-items")
    size = F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda n, t: n + F.octet_length(t) + 2))
    blocks = max(1, math.ceil((terms.agg(size).first()[0] or 0) / block_bytes))
    parts = []
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_bytes
        if not rows:
            continue
        rows.sort(key=lambda r: (r.item_id is not None, r.item_id))
        block = spark.sparkContext.broadcast(Terms([r.terms for r in rows]))
        names = spark.createDataFrame(
            pa.table({"item": pa.array(range(len(rows)), pa.int32()), "item_id": pa.array([r.item_id for r in rows])})
        ).select("item", F.col("item_id").cast(terms.schema["item_id"].dataType))
        best = ranked(candidates(docs, block, k), k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        parts.append(written(best, "search-block") if blocks > 1 else best)
        if blocks > 1:
            block.destroy()
    if not parts:
        fields = [terms.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))
    result = parts[0]
    for p in parts[1:]:
        result = result.union(p)
    return result


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_all FROM d WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM t, s GROUP BY term, n_docs),
g AS (
  SELECT q.item_id, d.r, d.doc_id,
    sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + ((50 * len(d.terms) * s.n_docs) // s.n_all)))))::BIGINT AS score
  FROM t JOIN w USING (term) JOIN q USING (term) JOIN d USING (r), s GROUP BY q.item_id, d.r, d.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
