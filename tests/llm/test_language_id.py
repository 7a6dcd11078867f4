import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brevier.llm import language_id as L
from brevier.llm.common import held_out


def counts_of(texts, order):
    rows = []
    for lang, raw in texts.items():
        for k in range(order + 1):
            padded = b"\n" * order + raw
            for gram, n in Counter(padded[i - k : i + 1] for i in range(k, len(padded))).items():
                rows.append((lang, k, int.from_bytes(gram, "big"), n))
    return pd.DataFrame(rows, columns=["lang", "order", "gram", "n"])


def slow_bits(counts, lang, raw, order):
    own = counts[counts.lang == lang]
    seen = {(o, g): n for o, g, n in zip(own.order, own.gram, own.n, strict=True)}
    total, kinds = Counter(), Counter()
    for (o, g), n in seen.items():
        total[o, g >> 8] += n
        kinds[o, g >> 8] += 1
    padded, bits = b"\n" * order + raw, 0.0
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            g = int.from_bytes(padded[i - k : i + 1], "big")
            n, d = total[k, g >> 8], kinds[k, g >> 8]
            if (k, g) in seen:
                bits += math.log2((n + d) / seen[k, g])
                break
            if d:
                bits += math.log2((n + d) / d)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(monkeypatch):
    texts = {"aa": b"abracadabra abra cadabra", "bb": "b\u00e4b\u00e4 b\u00f6b\u00f6 abba".encode()}
    counts = counts_of(texts, 3)
    trees = L.Trees(counts, 3)
    tests = [b"a", b"abra", b"xyz abba", "b\u00e4r".encode(), b"\x00\xff" * 9]
    expected = np.array([[slow_bits(counts, lang, t, 3) for lang in ("aa", "bb")] for t in tests])
    assert np.allclose(trees.code_lengths(tests), expected)
    monkeypatch.setattr(L, "SLICE", 5)
    assert np.allclose(trees.code_lengths(tests), expected)


def test_held_out_accuracy_and_edge_cases(spark, nasty, empty):
    import random

    rng = random.Random(2)
    make = lambda words: " ".join(rng.choice(words) for _ in range(30))
    words = {"en": "the house of light and stone".split(), "de": "das haus aus licht und stein".split()}
    rows = [(k, make(words[lang]), lang) for k, lang in enumerate(["en", "de"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = L.train(docs, ~held_out("doc_id", 3, 1))
    found = L.identify(docs, trees, keep=("lang",)).where(held_out("id", 3, 1))
    assert found.count() > 10 and found.where("lang_pred <> lang").count() == 0
    got = {r.id: r for r in L.identify(nasty.where("doc_id < 14"), trees).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 13))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[12].lang_pred in ("en", "de")
    assert L.identify(nasty, trees).count() == nasty.count()
    none = L.train(empty, F.lit(True))
    assert {r.lang_pred for r in L.identify(nasty, none).collect()} == {"und"}
    assert L.identify(empty, trees).count() == 0


def test_training_counts_equal_brute_force_and_the_sample_is_bounded(spark):
    rows = [(k, f"text {k} of language {k % 2}", "en" if k % 2 else "de") for k in range(30)] + [(None, "no id", "en"), (31, None, "en"), (32, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = ~held_out("doc_id", 3, 1)
    allowed = {r.doc_id for r in docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()}
    assert None not in allowed and 31 not in allowed and 10 < len(allowed) < 30
    trees = L.train(docs, learn, max_order=3)
    counts = pd.concat([counts_of({lang: t.encode()}, 3) for k, t, lang in rows if k in allowed]).groupby(["lang", "order", "gram"], as_index=False).n.sum()
    wanted = L.Trees(counts, 3)
    # Texts are joined by the padding before each, which adds contexts across texts in training alone.
    probe = [b"text 3 of language 1", b"text 8 of language 0"]
    assert trees.langs == wanted.langs
    assert trees.code_lengths(probe).argmin(1).tolist() == wanted.code_lengths(probe).argmin(1).tolist() == [1, 0]
    few = L.sampled(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)), F.lit(True), "doc_id", "text", "lang", 5).count()
    assert few < 30


def test_kept_columns_of_clashing_names(nasty):
    trees = L.Trees(counts_of({"aa": b"abra", "bb": b"xyz"}, 2), 2)
    found = L.identify(nasty.withColumn("score", F.lit("x")), trees, keep=("id", "score", "lang"))
    assert found.columns == ["id", "lang_pred", "score", "bits", "kept_id", "kept_score", "lang"]
    assert found.count() == nasty.count() and {r.kept_score for r in found.collect()} == {"x"}
