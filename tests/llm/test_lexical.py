"""Ranked search against SQL and against plain loops."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import oracle
from concord.llm import lexical, queries

ITEMS = "item_id bigint, text string"


def words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, k=lexical.BEST):
    """(item, rank, doc, score) by looking at every document for every item."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    big_n = sum(bool(c) for _, c in counted)
    big_l = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c in counted:
            n = sum(c.values())
            score = 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * big_n // big_l)))
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [
    (1, "The cat sat on the mat; the CAT, the mat."),
    (1, "The cat sat on the mat; the CAT, the mat."),
    (2, None),
    (3, ""),
    (4, " \t.,;!"),
    (None, "cat without id"),
    (None, "cat without id"),
    (5, "Ünïcödé É x 漢字 \x00cat\x7fdog_mat concat cats"),
    (6, "mat " * 5_000),
    (7, "a" * 20_000),
    (-8, "dog"),
]
QUERIES = [(10, "cat mat"), (11, None), (12, "... !"), (13, "DOG dog concat"), (None, "é É x 漢字"), (10, "dog"), (14, "absent")]


@pytest.fixture
def small(documents, spark):
    clashing = spark.createDataFrame(QUERIES, ITEMS).withColumns({n: F.lit(1) for n in ("term", "doc_id", "rank", "item", "terms")})
    docs = documents(DOCS)
    for name in ("item", "item_id", "score", "rank", "part", "term", "n"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs, clashing


def test_against_loops(small):
    assert found(lexical.search(*small)) == plain(DOCS, QUERIES)


def test_a_block_for_each_item(small):
    assert found(lexical.search(*small, block_bytes=1)) == plain(DOCS, QUERIES)


def test_few_places_and_many_ties(documents, spark):
    docs = [(k, ("same words here" if k % 3 else "same words there") + (" again" if k % 7 == 0 else "")) for k in range(400, 0, -1)]
    items = [(1, "same"), (2, "words again"), (3, "there")]
    df = lexical.search(documents(docs).repartition(7), spark.createDataFrame(items, ITEMS), k=9)
    assert found(df) == plain(docs, items, 9)


def test_parts_of_a_batch(documents, spark, monkeypatch):
    monkeypatch.setattr(lexical, "SCORES", 3)
    docs = [(k, f"w{k % 5} w{k % 3} x") for k in range(40)]
    items = [(1, "w1 w2"), (2, "x w4")]
    assert found(lexical.search(documents(docs), spark.createDataFrame(items, ITEMS))) == plain(docs, items)


def test_text_ids(documents, spark):
    docs = documents([(k, "one word") for k in range(9)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    rows = lexical.search(docs, spark.createDataFrame([("q", "word")], "item_id string, text string"), k=3).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in sorted(rows, key=lambda r: r.rank)] == [("q", 1, "d0"), ("q", 2, "d1"), ("q", 3, "d2")]


def test_empty_tables(documents, empty_documents, spark):
    none, one = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "cat")], ITEMS)
    assert lexical.search(documents(DOCS), none).collect() == []
    assert lexical.search(empty_documents, one).collect() == []
    assert lexical.search(empty_documents, none).collect() == []


def test_query_against_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.difference(spark, con, queries.op12_lexical_search, lexical.SQL, sf_dir) is None
