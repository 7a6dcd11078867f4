import numpy as np
import pytest
from pyspark.sql import functions as F

from brevier.llm.substring_dedup import Powers, level_lengths, sliding, substring_dedup, window_hashes


def brute(rows, window):
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc_id, text in order:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((doc_id, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "shortest", "groups", "keys"), [(20, 10, 20_000, 300), (20, 5, 30_000, 4000), (4, 4, 2_000_000, 2_000_000), (2, 1, 60_000, 500)])
def test_equals_brute_force(nasty, window, shortest, groups, keys):
    got = substring_dedup(nasty, window=window, shortest=shortest, bytes_per_group=groups, keys_per_range=keys)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute([(r.doc_id, r.text) for r in nasty.collect()], window)


def test_verbatim_and_kept_columns(nasty):
    got = substring_dedup(nasty, keep=("source", "grp"), verbatim=True)
    assert got.columns == ["id", "n_words", "n_removed", "kept_text", "source", "grp"]
    clash = substring_dedup(nasty.withColumn("n_words", F.lit("x")), keep=("id", "n_words", "key"))
    assert clash.columns == ["id", "n_words", "n_removed", "kept_text", "kept_id", "kept_n_words", "key"]
    assert {r.kept_n_words for r in clash.collect()} == {"x"}
    texts = {r.text for r in nasty.collect()}
    assert all(r.kept_text in texts for r in got.where("n_removed = 0").collect())


def test_empty_and_odd(empty):
    assert substring_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(empty, window=3)


def test_levels():
    assert level_lengths(20, 10) == [10, 20] and level_lengths(20, 1) == [5, 10, 20] and level_lengths(6, 6) == [6]


def test_window_hashes_depend_on_content_alone():
    words = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    found = window_hashes(words, 3, Powers(0x9E3779B97F4A7C15))
    assert found[0] == found[3] and len(set(found.tolist())) == 4
    assert sliding(np.arange(10), 4).tolist() == list(range(7))
