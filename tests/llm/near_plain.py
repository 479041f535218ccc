"""Near-duplicates by looking at all pairs of texts."""

from collections import defaultdict


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def pairs(texts, similarity=0.8):
    """(a, b, Jaccard similarity) of all pairs that reach it; only pairs with a shingle in common can."""
    sets, holders, common = [shingles(t) for t in texts], defaultdict(list), defaultdict(int)
    for k, found in enumerate(sets):
        for s in found:
            holders[s].append(k)
    for held in holders.values():
        for j, b in enumerate(held):
            for a in held[:j]:
                common[a, b] += 1
    alike = ((a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in common.items())
    return [(a, b, j) for a, b, j in alike if j >= similarity]


def groups(texts, similarity=0.8):
    """Lists of the places of texts that chains of such pairs connect."""
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b, _ in pairs(texts, similarity):
        parent[find(a)] = find(b)
    found = defaultdict(list)
    for k in range(len(texts)):
        found[find(k)].append(k)
    return list(found.values())
