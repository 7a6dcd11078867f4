import random

import xxhash

from brevier.llm.common import components
from brevier.llm.simhash import ball_links, drop_near_duplicates, fingerprint, near_duplicate_groups


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_fingerprints_and_groups(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    assert [fingerprint(t) for _, t in rows] == prints
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots(links)
    names = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root[k]] = min(doc_id, names.get(root[k], doc_id))
    expected = sorted([(d, p, names.get(root[k])) for k, ((d, _), p) in enumerate(zip(rows, prints, strict=True))], key=repr)
    got = [(r.id, r.fp & (1 << 64) - 1, r.component) for r in near_duplicate_groups(nasty).collect()]
    assert sorted(got, key=repr) == expected


def test_links_connect_all_within_two_bits(spark):
    rng = random.Random(3)
    values = []
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(4):
            values.append(at)
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    found = roots([(r.u, r.v) for r in ball_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()])
    near = roots([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    groups = lambda r: {frozenset(x for x in r if r[x] == y) for y in r.values()}
    assert groups(found) == groups(near)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(40)}


def test_drop_keeps_the_smallest(nasty, empty):
    assert near_duplicate_groups(empty).count() == 0
    kept = {r.doc_id for r in drop_near_duplicates(nasty).collect()}
    assert 5 in kept and 6 not in kept and None in kept
