import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brevier.llm import near_copies
from brevier.llm.near_copies import bit_distance, bits_for, drop_near_copies, met_pairs, near_copy_groups, shingle_set, short_prints, simhash_words, tables_for
from brevier.llm.near_copies import completed, marks, postings, prefixes, row_key, sets_of
from tests.llm.test_simhash import roots


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus():
    """Texts with copies of which some words are changed: similarities lie on both sides of 0.8."""
    rng = random.Random(11)
    texts = []
    for k in range(40):
        words = prose(rng, rng.choice([3, 60, 200, 700]))
        texts.append(" ".join(words))
        for _ in range(4):
            near = list(words)
            for at in rng.sample(range(len(near)), min(len(near), rng.choice([0, 1, len(near) // 60, len(near) // 40, len(near) // 25]))):
                near[at] = "changed"
            texts.append(" ".join(near).upper() if k % 2 else " ".join(near))
    return texts


def kept_by_brute_force(texts):
    sets = [shingles(t) for t in texts]
    root = roots([(a, b) for a in range(len(sets)) for b in range(a + 1) if jaccard(sets[a], sets[b]) >= 0.8])
    return {root[k] for k in root}


def test_stage_against_brute_force(spark):
    texts = corpus()
    assert len(kept_by_brute_force(texts)) > 40
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(kept_by_brute_force(texts))


def test_a_text_between_near_copies_parts_none(spark):
    """Candidates that share bands without being near copies; small bands' order must not matter."""
    rng = random.Random(2)
    base = prose(rng, 300)
    texts = []
    for _ in range(30):
        far = list(base)
        for at in rng.sample(range(300), 9):
            far[at] = f"c{rng.randrange(9)}"
        near = list(far)
        near[rng.randrange(300)] = "x"
        texts += [" ".join(far), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    expected = roots([(a, b) for a in range(60) for b in range(a + 1) if jaccard(sets[a], sets[b]) >= 0.8])
    got = {}
    for r in near_copy_groups(docs).collect():
        got.setdefault(r.group, set()).add(r.id)
    assert len(got) > 1
    assert {frozenset(g) for g in got.values()} == {frozenset(k for k in expected if expected[k] == x) for x in expected.values()}


def family(rng, n, own=41):
    """n pairs of near copies that share a frame: texts of unlike pairs have a similarity of 0.74."""
    frame, texts = prose(rng, 300), []
    for k in range(n):
        words = frame[:100] + [f"own{k}x{j}" for j in range(own)] + frame[100 + own :]
        near = list(words)
        for j in rng.sample(range(300), 3):
            near[j] = f"new{k}x{j}"
        texts += [" ".join(words), " ".join(near)]
    return texts


@pytest.mark.parametrize("n", [30, 1000])
def test_no_pair_of_a_family_is_lost(spark, n):
    texts = family(random.Random(n), n)
    sets = [shingles(t) for t in texts[:60]]
    assert all(jaccard(a, b) > 0.8 for a, b in zip(sets[::2], sets[1::2], strict=True)) and 0.65 < jaccard(sets[0], sets[2]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    group = {r.id: r.group for r in near_copy_groups(docs).collect()}
    assert [k for k in range(n) if group[2 * k] != group[2 * k + 1]] == []


def test_met_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30), k, rng.getrandbits(3)) for k in range(60)] + [(99, k, rng.getrandbits(3)) for k in range(100, 140)]
    balls = {}
    for ball, node, check in rows:
        balls.setdefault(ball, []).append((node, check))
    wanted = {}
    for own in balls.values():
        for (u, a), (v, b) in zip(own, own[1:], strict=False):
            if (a ^ b).bit_count() <= 1:
                wanted[u, v] = wanted.get((u, v), False) or len(own) > 4
    frame = spark.createDataFrame(rows, "ball long, node long, check long")
    for size in ("2", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {(r.u, r.v): r.crowded for r in met_pairs(frame, 1).collect()} == wanted
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(nasty, empty):
    assert drop_near_copies(empty).count() == 0
    kept = {r.doc_id for r in drop_near_copies(nasty).collect()}
    assert 0 in kept and 5 in kept and not {1, 2, 6} & kept
    assert len(shingle_set("a b")) == 1 and len(shingle_set(None)) == 0
    assert simhash_words(shingle_set("One two"), 2).tolist() == simhash_words(shingle_set(" one\ntwo "), 2).tolist()


def test_fingerprints():
    assert [bits_for(n) for n in (0, 600_000, 10**7, 10**9)] == [24, 24, 29, 36]
    assert 8 < tables_for(24, 0.8) < tables_for(30, 0.8) < 30 and tables_for(24, 1.0) == 1
    line = sum(1 << b for b in (0, 2, 24, 50, 70))
    words = np.array([line & (1 << 64) - 1, line >> 64], np.uint64)
    assert short_prints(words, 24, 3) == [5, 1, (1 << 2) + (1 << 22)]
    rng = np.random.default_rng(5)
    a, own = rng.integers(0, 1 << 63, 900, np.uint64), rng.integers(0, 1 << 63, 100, np.uint64)
    other = np.concatenate([a, rng.integers(0, 1 << 63, 100, np.uint64)])
    words = simhash_words(np.concatenate([a, own]), 20) ^ simhash_words(other, 20)
    assert abs(sum(int(w).bit_count() for w in words) / 1280 - bit_distance(900 / 1100)) < 0.03


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, null ids and ids shared by unlike texts."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(prose(rng, 50)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, d), (4, d), (4, d)]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(1, a), (2, b), (None, c), (3, d)], key=repr)


def alternating(rng, n=120, chunks=40):
    """Texts that share variants by chance of order: each near copies with others that stand between further ones."""
    base, texts = prose(rng, 400), []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(chunks), 5 + k % 4):
            words[at * 10] = f"c{rng.randrange(3)}x{at}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("found", "few"), [(0, 0), (0.5, 1000)])
def test_completion_finds_every_link(spark, monkeypatch, found, few):
    """Whatever share of the links the first pass has brought, by rounds or at once, and with all shingles, some or none put last."""
    monkeypatch.setattr(near_copies, "FEW", few)
    rng = random.Random(9)
    texts = alternating(rng) + corpus() + family(rng, 20)
    sets = [shingle_set(t) for t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    nodes = docs.select(F.col("doc_id").alias("node"), F.struct(row_key("doc_id", "text").alias("key")).alias("first"))
    links = spark.createDataFrame([p for p in near if rng.random() < found], "u long, v long")
    expected = roots(near)
    read = lambda wanted: sets_of(wanted, nodes, docs, "doc_id", "text", 5)
    for late in (marks(docs, "text", 5), np.zeros(16, np.uint64), np.full(16, 2**64 - 1, np.uint64)):
        rows = postings(prefixes(docs, "doc_id", "text", 5, 0.8, late), nodes)
        got = roots([(r.u, r.v) for r in completed(links, rows, read, 0.8).collect()])
        assert {k: r for k, r in got.items()} == {k: r for k, r in expected.items()}


def test_links_that_the_first_pass_misses_are_found(spark, monkeypatch):
    """No pair meets at a variant: the groups are those of brute force all the same."""
    monkeypatch.setattr(near_copies, "met_pairs", lambda rows, furthest: rows.where("false").selectExpr("node as u", "node as v"))
    texts = corpus() + alternating(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == sorted(kept_by_brute_force(texts))


def test_parities_part_no_near_copies():
    """They differ in no more bits than the sets have shingles apart, whatever the sizes."""
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 300, 513, 4000):
        for changed in (0, 1, size // 20, size // 4):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed // 2, np.uint64)]))
            apart = len(np.setxor1d(a, b))
            for bits in (near_copies.PARITY_BITS, near_copies.WIDE_BITS):
                x, y = near_copies.parity(a, bits).view(np.uint64), near_copies.parity(b, bits).view(np.uint64)
                assert len(x) == bits // 64 and int(np.bitwise_count(x ^ y).sum()) <= apart


@pytest.mark.parametrize("length", [250, 2500])
def test_a_family_that_is_not_near_enough_brings_few_pairs(spark, monkeypatch, length):
    """Pairs whose sets are read grow with the texts, not with the square of the family; none that is near is lost."""
    rng, compared = random.Random(length), []
    frame, texts = prose(rng, length), []
    for k in range(120):
        own = length // 6
        words = frame[: length // 3] + [f"own{k}x{j}" for j in range(own)] + frame[length // 3 + own :]
        near = list(words)
        near[rng.randrange(length)] = f"new{k}"
        texts += [" ".join(words), " ".join(near)]
    sets = [shingles(t) for t in texts]
    assert jaccard(sets[0], sets[1]) > 0.9 and 0.65 < jaccard(sets[0], sets[2]) < 0.75
    read = near_copies.joined
    monkeypatch.setattr(near_copies, "joined", lambda pairs, *more: compared.append(pairs.count()) or read(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == list(range(0, 240, 2))
    assert sum(compared) <= 4 * len(texts)


def test_rows_to_drop_may_be_many(spark, monkeypatch):
    """The same rows stay if their keys are shuffled and not broadcast."""
    monkeypatch.setattr(near_copies, "MOST_BROADCAST", 0)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == sorted(kept_by_brute_force(texts))


def test_rows_that_share_half_a_key_with_one_to_drop_stay(spark, monkeypatch):
    """As if all first halves of keys were alike: then the whole key decides."""
    key = near_copies.row_key
    monkeypatch.setattr(near_copies, "row_key", lambda *row: F.struct(F.lit(1).cast("long").alias("a"), key(*row)["b"].alias("b")))
    rng = random.Random(8)
    a, b = (" ".join(prose(rng, 60)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (2, a), (3, b), (4, None), (4, None)], "doc_id long, text string")
    for most in (near_copies.MOST_BROADCAST, 0):
        monkeypatch.setattr(near_copies, "MOST_BROADCAST", most)
        assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 3, 4]
