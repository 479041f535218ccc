"""Against all pairs of fingerprints."""

import random

import pytest
import xxhash

from concord.llm import queries, simhash
from concord.llm.base import table


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fingerprints, distance=3):
    """Index of the smallest member reachable, for each."""
    parent = list(range(len(fingerprints)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j, b in enumerate(fingerprints):
        for i, a in enumerate(fingerprints[:j]):
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(k) for k in range(len(fingerprints))]


def test_whole_table(spark, sf_dir):
    docs = sorted(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    expected = [fingerprint(d.text) for d in docs]
    roots = components(expected)
    rows = {r.doc_id: r for r in queries.op9_simhash(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d, fp, root in zip(docs, expected, roots, strict=True):
        assert rows[d.doc_id].fingerprint == f"{fp:016x}"
        assert rows[d.doc_id].component_id == docs[root].doc_id


@pytest.mark.parametrize("seed", range(3))
def test_links_are_all_pairs_within_three_bits(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base:
        for _ in range(25):
            flips = rng.sample(range(64), rng.randint(1, 5))
            fps.add(b ^ sum(1 << k for k in flips))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()}
    mask = (1 << 64) - 1
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert found == expected


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(300, 340)]
    edges = [*chain, *star, (900, 901), (901, 900), (339, 7)]
    rows = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    for k in range(101, 161):
        assert rows[k] == 100
    for k in range(300, 340):
        assert rows[k] == 7
    assert rows[901] == 900
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in zero) == [(False, 2), (False, 3), (False, 4), (True, 0)]
    assert {r.component_id for r in zero} == {2}
    assert [r.component_id for r in rows if r.doc_id == 1] == [1, 1]
    alone = [r for r in rows if r.doc_id is None and r.fingerprint != "0" * 16]
    assert [r.component_id for r in alone] == [None]


def test_one_row_of_each_group_stays(awkward):
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    groups = {r.component_id for r in simhash.near_duplicates(awkward).collect()}
    assert len(rows) == len(groups)
    assert {r.doc_id for r in rows} == groups
    assert {r.fp for r in rows} == {"clash"}


def test_empty_table(empty_documents):
    assert simhash.near_duplicates(empty_documents).collect() == []
    assert simhash.deduplicate(empty_documents).collect() == []


def test_long_text_counts_in_chunks(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(5000))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.simhash(text) == whole
    assert whole & ((1 << 64) - 1) == fingerprint(text)


def test_recall_against_five_word_jaccard():
    """The figures of README: the law finds copies with next to no edits, not all that are alike by Jaccard."""
    import pyarrow.parquet as pq

    rng = random.Random(7)
    base = sorted({t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t and len(t.split()) >= 50})
    texts = list(base)
    for text in base:
        words = text.split()
        for rate in (0.002, 0.005, 0.01, 0.02, 0.04):
            changed = list(words)
            for k in rng.sample(range(len(words)), max(1, round(rate * len(words)))):
                changed[k] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    fps = [simhash.simhash(t) & ((1 << 64) - 1) for t in texts]
    have, found, all_pairs = {}, [0] * 4, [0] * 4
    for i, shingles in enumerate(sets):
        shared = {}
        for s in shingles:
            for j in have.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            have[s].append(i)
        for j, n in shared.items():
            jaccard = n / (len(shingles) + len(sets[j]) - n)
            if 0.8 <= jaccard < 1:
                band = (jaccard >= 0.9) + (jaccard >= 0.95) + (jaccard >= 0.98)
                all_pairs[band] += 1
                found[band] += (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_DISTANCE
    assert (found, all_pairs) == ([488, 690, 522, 133], [3544, 1765, 785, 152])


def test_unlike_texts_under_one_id_stay(documents):
    one, other = "the first text of a few words about rivers", "nothing like it stands here, only numbers: 1 2 3"
    docs = documents([(1, one), (1, other), (1, one), (2, other), (None, one), (3, None), (3, "third " * 9)])
    rows = simhash.deduplicate(docs).collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.text) == sorted([(1, one), (1, other), (3, "third " * 9)])
    assert [r.doc_id for r in rows if not r.text] == [3]


def test_the_row_that_stays_is_the_same_in_any_order(documents, spark):
    docs = documents([(1, "one text under one id")] * 12)
    kept = {tuple(simhash.deduplicate(docs.orderBy(c).repartition(n)).first()) for c in ("lang", "source") for n in (1, 5)}
    assert len(kept) == 1


@pytest.mark.parametrize("hot_key", [4, 4096])
def test_hot_segments_lose_and_repeat_no_link(spark, monkeypatch, hot_key):
    monkeypatch.setattr(simhash, "HOT_KEY", hot_key)
    some = random.Random(hot_key)
    high, low = some.getrandbits(32), some.getrandbits(32)
    values = {high << 32 | some.getrandbits(32) for _ in range(120)} | {some.getrandbits(32) << 32 | low for _ in range(120)}
    for v in list(values):
        for _ in range(2):
            near = v
            for k in some.sample(range(64), some.randint(1, 4)):
                near ^= 1 << k
            values.add(near)
    signed = [v - (v >> 63 << 64) for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for distance in (1, 2, 3):
        expected = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
        assert sorted(map(tuple, simhash.links(nodes, distance).collect())) == expected


def test_a_shared_half_does_not_pair_all(spark):
    some = random.Random(2)
    nodes = spark.createDataFrame([(some.getrandbits(32),) for _ in range(6_000)], "fp bigint").distinct()
    met = simhash.links(nodes)
    assert met.count() == met.distinct().count()
    plan = met._jdf.queryExecution().executedPlan()
    rows = []

    def walk(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    met.collect()
    walk(plan.executedPlan() if "Adaptive" in plan.nodeName() else plan)
    assert sum(rows) < 6_000**2 / 10
