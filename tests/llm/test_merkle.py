import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevier.llm import merkle as M

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def slow_tree(nodes, fanout):
    """The root, and for each node the siblings from the bottom up."""
    own = [[k] for k in range(len(nodes))]
    proof = [[] for _ in nodes]
    while len(nodes) > 1:
        above, held = [], []
        for k in range(0, len(nodes), fanout):
            run = nodes[k : k + fanout]
            for j in range(len(run)):
                for i in own[k + j]:
                    proof[i] += run[:j] + run[j + 1 :]
            above.append(digest(*run))
            held.append(sum(own[k : k + fanout], []))
        nodes, own = above, held
    return nodes[0], proof


def slow_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, proofs = [], {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroot, proof = slow_tree([leaf(r) for r in own], fanout)
        subroots.append(subroot)
        proofs[g] = [(r["doc_id"], leaf(r), k, p) for k, (r, p) in enumerate(zip(own, proof, strict=True))]
    root, upper = slow_tree(subroots, fanout)
    return sorted(
        ((i, own, g, k, s, root, "".join(p + u)) for g, s, u in zip(order, subroots, upper, strict=True) for i, own, k, p in proofs[g]),
        key=repr,
    )


def found(df):
    return sorted(((r.id, r.leaf, r.group, r.position, r.subroot, r.root, r.proof) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout, most", [(2, 4), (3, 1024), (5, 25), (2, 1024)])
def test_manifest_equals_brute_force(spark, nasty, fanout, most):
    """Blocks of few leaves make several tiers."""
    rng = random.Random(fanout)
    rows = [(rng.choice([None, *range(60)]), f"t{rng.randrange(9)}", rng.choice(["en", "", None, "é", "z"]), "s", 3) for _ in range(150)]
    docs = nasty.select(*FIELDS).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = M.fold(M.manifest(docs, fanout=fanout, most_leaves=most), fanout=fanout).cache()
    assert found(got) == slow_manifest([r.asDict() for r in docs.collect()], fanout)
    assert got.where("folded_root != root").count() == 0


def test_numbers_are_dealt_over_ranges(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 990, "a").otherwise("b").alias("branch"), (F.col("id") % 7).alias("k"), "id")
    got = M.numbered(rows, ["k", "id"], per_range=100, most=90).collect()
    own = sorted((r.branch, r.k, r.id) for r in got)
    assert [(r.branch, r.k, r.id) for r in sorted(got, key=lambda r: (r.branch, r.position))] == own
    assert {(r.branch, r["size"]) for r in got} == {("a", 990), ("b", 10)} and sorted(r.position for r in got if r.branch == "b") == [*range(10)]


def test_changed_leaves_fail_and_names_may_clash(spark, nasty, empty):
    docs = nasty.withColumn("root", F.lit("x")).withColumn("now", M.leaf_digest(F.col("doc_id"), F.lit("other")))
    kept = M.manifest(docs, keep=("root", "id", "now", "text"))
    assert {"kept_root", "kept_id", "now", "text"} <= set(kept.columns) and kept.count() == nasty.count()
    assert kept.where("kept_root = 'x' and root != 'x'").count() == nasty.count()
    assert M.fold(kept, leaf="now").where("folded_root = root").count() == 0
    assert M.fold(kept.withColumn("none", F.lit(None).cast("string")), leaf="none").where("folded_root is not null").count() == 0
    assert M.manifest(empty).count() == 0
    one = M.manifest(nasty.where("doc_id = 3")).first()
    assert one.leaf == one.subroot == one.root and one.proof == "" and one.n_groups == 1
    with pytest.raises(ValueError):
        M.manifest(nasty, fanout=1)


def test_levels_and_folding():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 9, 20):
        for fanout in (2, 3, 4):
            leaves = M.hashed_rows(rng.integers(0, 255, (n, 5), np.uint8))
            tree = M.levels(leaves, fanout)
            texts = [r.tobytes().decode() for r in leaves]
            root, proof = slow_tree(texts, fanout)
            assert tree[-1].tobytes().decode() == root
            assert M.proofs(tree, fanout, b"f" * 64).to_pylist() == ["".join(p) + "f" * 64 for p in proof]
            assert all(M.folded(t, "".join(p), [(k, n)], fanout) == root for k, (t, p) in enumerate(zip(texts, proof, strict=True)))
