import random
from collections import Counter

import pytest

import corpus_pipeline
from brevier.llm.common import held_out
from brevier.llm.language_id import train
from tests.llm.test_decontaminate import slow_tiles
from tests.llm.test_near_copies import jaccard, shingles
from tests.llm.test_simhash import roots
from tests.llm.test_substring_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def made():
    """Documents in two languages with null and wordless texts, copies, near copies, shared passages and benchmark items."""
    rng = random.Random(8)
    words = {"en": [f"the{k}" for k in range(400)], "de": [f"der{k}ß" for k in range(400)]}
    prose = lambda lang, n: [rng.choice(words[lang]) for _ in range(n)]
    items = [(k, " ".join(prose("en", 12))) for k in range(6)]
    passage = prose("de", 60)
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "de"
        text = prose(lang, rng.choice([5, 40, 120]))
        if k % 7 == 0:
            text += passage
        if k % 11 == 0:
            own = items[k % 6][1].split()
            text[3:3] = own[6:] + ["then"] + own[:6]
        rows.append((k, " ".join(text), lang, f"s{k % 3}", 1))
        if k % 5 == 0:
            near = list(text)
            near[len(near) // 2] = "changed"
            rows.append((100 + k, " ".join(near), lang, None, None))
    rows += [rows[3], (200, rows[4][1], "en", "s", 2), (None, rows[5][1], "en", "s", 3), (None, None, None, None, None), (201, "", "en", "s", 0), (202, "12 34 !?", None, None, 1)]
    return rows, items


def test_whole_pipeline_against_brute_force(spark, made, tmp_path):
    rows, items = made
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)

    def step(name, docs):
        STAGES[name](spark, docs, sf).write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        return found, Counter(map(tuple, found.collect()))

    known, got = step("language ID", docs)
    assert got == Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))

    kept, got = step("SimHash near-dedup", known)
    own = sorted(known.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [shingles(r.text) for r in own]
    root = roots([(a, b) for a in range(len(own)) for b in range(a + 1) if jaccard(sets[a], sets[b]) >= 0.8])
    assert got == Counter(tuple(own[k]) for k in set(root.values()))

    cut, got = step("substring dedup", kept)
    wanted = Counter()
    texts = {r.doc_id: r for r in kept.collect()}
    for doc_id, _, removed, text in brute([(r.doc_id, r.text) for r in texts.values()], 20):
        r = texts[doc_id]
        wanted[(doc_id, text if removed else r.text, r.lang, r.source, len(text) if removed else r.n_chars)] += 1
    assert got == wanted and any(r[4] and r[4] > 1 for r in got)

    clean, got = step("benchmark decontamination", cut)
    words = lambda t: t.lower().split()
    bad = lambda t: any(sum(n for _, _, n in slow_tiles(words(i), words(t), 5)) >= 0.6 * len(words(i)) for _, i in items)
    assert got == Counter(tuple(r) for r in cut.collect() if not bad(r.text)) and sum(got.values()) < cut.count()

    packed, got = step("best-fit packing", clean)
    pieces = packed.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in clean.collect())
    by = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and sum(by.values()) == sum(r.length for r in pieces)

    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.length, r.ids_crc32) for r in pieces)
    assert len(train(docs, ~held_out("doc_id", 3, 1)).langs) == 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
