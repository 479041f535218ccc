import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from concord.llm import kdtree, queries
from concord.llm.base import table


def cut(rows, shards, ranges, first=0):
    """Shard of each row (size, keys, tie, index): the same tree in plain Python."""
    if shards == 1 or not rows:
        return {r[3]: first for r in rows}
    widths = [(max(r[1][k] for r in rows) - min(r[1][k] for r in rows)) / w for k, w in enumerate(ranges)]
    dim = widths.index(max(widths))
    left = (shards + 1) // 2
    goal = sum(r[0] for r in rows) * left / shards
    rows = sorted(rows, key=lambda r: (r[1][dim], r[2], r[3]))
    seen = 0
    for k, r in enumerate(rows):
        if seen + r[0] >= goal:
            k += seen + r[0] - goal <= goal - seen
            break
        seen += r[0]
    return cut(rows[:k], left, ranges, first) | cut(rows[k:], shards - left, ranges, first + left)


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [16, 5])
def test_whole_table_against_a_plain_tree(spark, sf_dir, shards):
    dims = [kdtree.prefix(F.col("lang")), kdtree.prefix(F.col("source")), kdtree.number(F.col("n_chars"))]
    docs = table(spark, sf_dir, "documents")
    plain = kdtree._narrow(docs, dims).collect()
    rows = [(r.size, (r.key0, r.key1, r.key2), r.tie, r.row) for r in plain]
    ranges = [max(max(r[1][k] for r in rows) - min(r[1][k] for r in rows), 1) for k in range(3)]
    expected = cut(rows, shards, ranges)
    found = kdtree.assign(docs, dims, shards).collect()
    assert {r.row: r.node for r in found} == expected


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op5_kdtree_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert (r.law, r.grown_shard) == ("bytes", None)
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
    check_slots(rows)


def test_copies_of_one_row_are_split(documents, spark):
    docs = documents([(1, "same text")] * 300 + [(k, f"text {k}") for k in range(50)])
    dims = [kdtree.number(F.col("n_chars")), kdtree.prefix(F.col("source"))]
    rows = kdtree.shard(docs, dims, 8).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 350
    assert max(sizes.values()) - min(sizes.values()) <= 20
    check_slots(rows)


def test_many_blocks(documents, monkeypatch):
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 7)
    docs = documents([(k, "x" * (k % 13)) for k in range(200)])
    check_slots(kdtree.shard(docs, [kdtree.number(F.col("n_chars"))], 4).collect())


def test_awkward_rows(awkward, empty_documents):
    dims = [kdtree.prefix(F.col("lang")), kdtree.number(F.col("n_chars"))]
    rows = kdtree.shard(awkward, dims).collect()
    assert len(rows) == awkward.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (2, 3)} == {(1, 0)}
    check_slots(rows)
    assert kdtree.shard(empty_documents, dims).collect() == []


def test_texts_with_a_shared_beginning_are_split_by_value(spark):
    rows = [(k, "x" * 100, f"https://example.org/{k % 4}") for k in range(200)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    ranks = {r.url: r["rank"] for r in kdtree._ranks(docs.select("url").where("url IS NOT NULL"), "url").collect()}
    assert ranks == {f"https://example.org/{k}": k for k in range(4)}
    found = kdtree.shard(docs, [kdtree.Text(F.col("url"))], 4).collect()
    assert len(found) == len(rows)
    shards = {r.doc_id: r.shard for r in found}
    assert len({(shards[k], k % 4) for k in range(200)}) == 4


def test_ranks_of_many_ranges(spark):
    spark_values = spark.range(5000).selectExpr("concat('https://', sha2(cast(id % 3000 AS string), 256)) AS v")
    found = {r.v: r["rank"] for r in kdtree._ranks(spark_values.repartition(7), "v").collect()}
    values = sorted({r.v for r in spark_values.collect()})
    assert found == {v: k for k, v in enumerate(values)}


def test_whole_table_by_ranks_against_a_plain_tree(spark, sf_dir):
    dims = [kdtree.Text(F.col("lang")), kdtree.Text(F.col("source")), kdtree.number(F.col("n_chars"))]
    docs = table(spark, sf_dir, "documents")
    names = [sorted({r[0] or "" for r in docs.select(c).collect()}) for c in ("lang", "source")]
    rows = []
    for r in kdtree._narrow(docs, dims).join(docs.select("doc_id", "lang", "source"), "doc_id").collect():
        assert (r.key0, r.key1) == (names[0].index(r.lang or ""), names[1].index(r.source or ""))
        rows.append((r.size, (r.key0, r.key1, r.key2), r.tie, r.doc_id))
    ranges = [max(max(r[1][k] for r in rows) - min(r[1][k] for r in rows), 1) for k in range(3)]
    assert {r.doc_id: r.shard for r in kdtree.shard(docs, dims).collect()} == cut(rows, 16, ranges)
