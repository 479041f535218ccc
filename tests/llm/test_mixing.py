import hashlib
import random
from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from concord.llm import mixing, queries
from concord.llm.base import table


def place(doc_id, epoch, seed):
    text = f"{seed}:{epoch}:{'null' if doc_id is None else doc_id}"
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(budget, children):
    """Targets of children (capacity, weight): fill by weight, give what is left over to those with room."""
    target = [0.0] * len(children)
    room = {k for k, (c, w) in enumerate(children) if w > 0 and c > 0}
    left = budget
    while room and left > 1e-9:
        total = sum(children[k][1] for k in room)
        share = {k: left * children[k][1] / total for k in room}
        full = {k for k in room if share[k] >= children[k][0] - target[k] - 1e-9}
        if not full:
            for k in room:
                target[k] += share[k]
            return target
        for k in full:
            left -= children[k][0] - target[k]
            target[k] = children[k][0]
        room -= full
    for k, (c, w) in enumerate(children):
        if w <= 0:
            target[k] = min(c, max(0, left))
            left -= target[k]
    return target


def tree_targets(leaves, weights, budget, epochs):
    """leaves: path -> tokens."""
    out, nodes = {}, [((), budget)]
    while nodes:
        path, budget = nodes.pop()
        depth = len(path)
        names = sorted({p[depth] for p in leaves if p[:depth] == path}, key=lambda n: (n is not None, n or ""))
        caps = [epochs * sum(t for p, t in leaves.items() if p[: depth + 1] == (*path, n)) for n in names]
        found = fill(budget, [(c, max(0.0, weights.get((*path, n), 1.0))) for n, c in zip(names, caps, strict=True)])
        for n, t in zip(names, found, strict=True):
            if (*path, n) in leaves:
                out[(*path, n)] = floor(t + 1e-6)
            else:
                nodes.append(((*path, n), floor(t + 1e-6)))
    return out


def plain(docs, weights, share, seed, epochs):
    """docs: (doc_id, path, tokens) -> Counter of (doc_id, path, epoch)."""
    leaves = defaultdict(int)
    for _, path, t in docs:
        leaves[path] += t
    targets = tree_targets(leaves, weights, floor(sum(leaves.values()) * share), epochs)
    out = Counter()
    for path, total in leaves.items():
        whole = targets[path] // total if total else epochs
        rest = targets[path] - whole * total
        own = [(d, t) for d, p, t in docs if p == path]
        for e in range(whole):
            out.update((d, path, e) for d, _ in own)
        if whole < epochs and rest:
            tokens = defaultdict(int)
            for d, t in own:
                tokens[place(d, whole, seed)] += t
            seen, end = 0, None
            for at in sorted(tokens):
                if seen + tokens[at] > rest:
                    nearer = seen + tokens[at] - rest < rest - seen
                    end = at + (nearer or (not whole and not seen))
                    break
                seen += tokens[at]
            out.update((d, path, whole) for d, _ in own if place(d, whole, seed) < end)
    return out


def estimate(text):
    return -(-len((text or "").encode()) // 4)


def test_whole_table(spark, sf_dir):
    docs = []
    for r in table(spark, sf_dir, "documents").collect():
        domain = "web" if r.source == "src0" else "reference" if len(r.source) == 4 else "forum"
        docs.append((r.doc_id, (domain, r.lang, r.source), estimate(r.text)))
    weights = {tuple(p): w for p, w in queries.MIX_WEIGHTS}
    expected = plain(docs, weights, queries.MIX_SHARE, mixing.SEED, mixing.MAX_EPOCHS)
    rows = queries.op10_mixing(spark, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.leaf.split("/")), r.epoch) for r in rows) == expected


@pytest.mark.parametrize("seed", range(4))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    docs = []
    for k in range(120):
        path = tuple(rng.choice(x) for x in (["a", "b", None], ["x", "y"], ["1", "2", "3"]))
        docs.append((k if k % 11 else None, path, "t" * rng.choice([0, 3, 40, 400, 401])))
    weights = {}
    for _, path, _ in docs:
        for depth in (1, 2, 3):
            if rng.random() < 0.6:
                weights[path[:depth]] = rng.choice([0.0, 0.5, 1.0, 4.0, 20.0, -1.0])
    share, epochs = rng.choice([0.1, 0.7, 1.5, 5.0]), rng.choice([1, 3])
    df = spark.createDataFrame([(d, *p, t) for d, p, t in docs], "doc_id bigint, a string, b string, c string, text string")
    given = spark.createDataFrame([(list(p), w) for p, w in weights.items()] or [([], 1.0)], "path array<string>, weight double")
    rows = mixing.mixed(df, [F.col("a"), F.col("b"), F.col("c")], given, share, seed, epochs).collect()
    expected = plain([(d, p, estimate(t)) for d, p, t in docs], weights, share, seed, epochs)
    found = Counter((r.doc_id, r.leaf, r.epoch) for r in rows)
    assert found == Counter({(d, "/".join(x or "null" for x in p), e): n for (d, p, e), n in expected.items()})


def test_no_leaf_with_a_target_stays_empty(spark):
    none = spark.createDataFrame([], "path array<string>, weight double")
    for seed in range(8):
        docs = [(1, "x", "t" * 4000), (2, "x", "t" * 40), (3, "x", "t" * 40), (4, "x", "t" * 400), (5, "y", "t" * 8000), (6, "y", "t" * 4)]
        df = spark.createDataFrame(docs, "doc_id bigint, a string, text string")
        rows = mixing.mixed(df, [F.col("a")], none, 0.1, seed, 1).collect()
        assert Counter((r.doc_id, r.leaf, r.epoch) for r in rows) == Counter(
            {(d, p[0], e): n for (d, p, e), n in plain([(d, (a,), estimate(t)) for d, a, t in docs], {}, 0.1, seed, 1).items()}
        )
        assert {r.leaf for r in rows} == {"x", "y"}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    nodes = [(("web", "en"), 100), (("web", "de"), 1000), (("ref", "en"), 5000)]
    found = tree_targets(dict(nodes), {}, 1600, 1)
    assert found == {("web", "en"): 100, ("web", "de"): 700, ("ref", "en"): 800}
    leaves = spark.createDataFrame([(*p, t) for p, t in nodes], "level0 string, level1 string, tokens bigint")
    weights = spark.createDataFrame([], "path array<string>, weight double")
    rows = mixing.budgets(leaves, weights, 2, 1600 / 6100, 1).collect()
    assert {(r.level0, r.level1): r.target for r in rows} == found


def test_awkward_rows(spark, awkward, empty_documents):
    weights = queries.mix_weights(spark)
    args = (queries.mix_levels(), weights)
    everything = mixing.sampled(awkward, *args, 1.0, max_epochs=1)
    assert everything.columns == awkward.columns
    assert everything.count() == awkward.count()
    assert mixing.mixed(awkward, *args, 5.0, max_epochs=2).count() == 2 * awkward.count()
    assert mixing.mixed(empty_documents, *args, 0.5).collect() == []
    assert mixing.sampled(empty_documents, *args, 0.5).collect() == []
