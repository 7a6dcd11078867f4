import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brevier.llm import spelling as S


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def slow_variants(counts, least=7, least_count=2, ratio=10):
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_count}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] is not None else None, root))
    return sorted(out)


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def frame(spark, counts):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, form string, id int")


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(8)
    out = {}
    for letters in ("ab", "aé", "abcdefghÿ\U0001f600"):
        for _ in range(150):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 10)))
            for _ in range(4):
                out[word] = int(2 ** rng.uniform(0, 16))
                k = rng.randrange(len(word) + 1)
                word = word[:k] + rng.choice([rng.choice(letters), ""]) + word[k + rng.randrange(2) :] or "a"
    out |= {"a" * k: 3**k for k in range(1, 12)} | {"z" * 3000: 50, "z" * 2999: 4, "z" * 1500 + "y" + "z" * 1499: 7}
    return out


def test_variants_equal_brute_force(spark, counts):
    assert found(S.spelling_variants(frame(spark, counts), least=1)) == slow_variants(counts, least=1)
    got = S.spelling_variants(frame(spark, counts), least=5, least_count=30, ratio=3)
    assert found(got) == slow_variants(counts, 5, 30, 3) and any(r.root != r.form and r.form for r in got.collect())


def test_colliding_keys_are_told_apart(spark, counts, monkeypatch):
    own = S.keyed
    few = {w: n for w, n in counts.items() if len(w) < 7}
    monkeypatch.setattr(S, "keyed", lambda words: own(words).selectExpr("key % 2 AS key", "id", "place", "first"))
    assert found(S.spelling_variants(frame(spark, few), least=1)) == slow_variants(few, least=1)


def test_many_parts_give_the_same(spark, counts, monkeypatch):
    own = S.candidates
    monkeypatch.setattr(S, "candidates", lambda keys, n: own(keys, n, per_part=500))
    assert found(S.spelling_variants(frame(spark, counts), least=1)) == slow_variants(counts, least=1)


def test_keys_are_those_of_the_shorter_words():
    words = ["banana", "anana", "baana", "x", "", "é\U0001f600é"]
    keys = {}
    for key, ids, place, first in S.keys_of(words, np.arange(len(words))):
        for k, i, p, f in zip(key.tolist(), ids.tolist(), place.tolist(), first.tolist(), strict=True):
            text = words[i] if p < 0 else words[i][:p] + words[i][p + 1 :]
            assert keys.setdefault(text, k) == k
            assert f == (p <= 0 or words[i][p] != words[i][p - 1])
    assert len({*keys.values()}) == len(keys)


def slow_counts(rows, damage):
    out = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{name}:{run}".encode())
            if damage and name is not None and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return out


def test_words_equal_brute_force(spark, nasty, empty):
    rng = random.Random(2)
    bits = ["Alphabet", "ALPHABET", "garçonnière", "ÉTRANGER", "étranger", "short", "überĀallem", "x" * 9, "-", "中", "naïvement", "letters7", "a×b÷cdef"]
    rows = [(rng.choice([None, k]), rng.choice([None, "".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(60))])) for k in range(50)]
    docs = spark.createDataFrame([(*r, 5, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    for damage in (0, 3):
        assert {r.word: r.n for r in S.count_words(docs, damage=damage).collect()} == slow_counts(rows, damage)
    every = [(r.doc_id, r.text) for r in nasty.collect()]
    assert {r.word: r.n for r in S.count_words(nasty, damage=2).collect()} == slow_counts(every, 2)
    assert S.spelling_variants(S.count_words(empty)).count() == 0
    with pytest.raises(ValueError):
        S.spelling_variants(S.count_words(empty), ratio=1)
