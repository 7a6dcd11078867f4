import math
import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brevier.llm import packing
from brevier.llm.packing import best_configuration, pack, pack_documents, packing_plan, sequences, solve, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_and_packing_round_trip(spark, nasty, empty):
    odd = ["it's <|endoftext|> x<|startoftext|>y", "caf\u0065\u0301 \u00c5\u0130 \u03a3\u03a3", "a\u00a0b\u2003c\x1cd", "\u4e2d\u6587, 123abc_--'s", "don't! (ok) \"q\""]
    docs = nasty.select("doc_id", "text").union(spark.createDataFrame([(200 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(PATH)
    wanted = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 512)):
            own = np.array(ids[start : start + 512], "<u4")
            wanted.append((r.doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    got = [tuple(r) for r in token_pieces(docs, PATH, capacity=512).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    packed = pack(token_pieces(docs, PATH, capacity=512, with_ids=True), capacity=512, rows_per_bucket=3)
    rows = packed.collect()
    assert len(rows) == len(wanted)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= 512
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    assert all(whole[k] == [i for r in own for i in r.ids] for k, own in by.items())
    assert pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_all_and_is_tight(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 1000): rng.randint(1, 40) for _ in range(60)}
    plan = packing_plan(histogram, 1000)
    n = plan.sequences
    placed = {}
    for length, first, times, sequence, offset in zip(*plan.rows, strict=True):
        placed.setdefault(length, []).append((first, times, sequence, offset))
    room = {}
    for length, count in histogram.items():
        own = sorted(placed[length])
        for k, (first, times, sequence, offset) in enumerate(own):
            end = own[k + 1][0] if k + 1 < len(own) else count
            for rank in range(first, end):
                ahead = rank - first
                room.setdefault(sequence + ahead // times, []).append((offset + ahead % times * length, length))
    assert len(room) == n
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1000
    bound = math.ceil(sum(k * v for k, v in histogram.items()) / 1000)
    bins: list[int] = []
    for size in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [(r, k) for k, r in enumerate(bins) if r >= size]
        if fits:
            bins[min(fits)[1]] -= size
        else:
            bins.append(1000 - size)
    assert bound <= plan.bound <= n <= 1.01 * len(bins) + 1
    assert plan.from_configurations >= 0.5 * n  # few lengths with hardly a full sequence among them


def test_linear_program_carries_the_plan():
    rng = np.random.default_rng(7)
    lengths, counts = np.unique(np.minimum(rng.lognormal(6.3, 1, 9000).astype(int) + 1, 4095), return_counts=True)
    plan = packing_plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert plan.from_configurations >= 0.8 * plan.sequences and plan.sequences <= plan.bound + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_carry_the_plan_of_a_wide_histogram(seed, monkeypatch):
    """Over 1,500 lengths around a third and over a half, where neither the tokens' bound nor best-fit is tight.

    Without multiplicative weights (rate 0) or with no linear program at all the plan is clearly longer.
    """
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(np.concatenate([rng.integers(1000, 1800, 9000), rng.integers(2049, 2900, 3000)]), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    fits = sum(m for m, _ in packing.best_fit(lengths, counts, 4096))
    assert len(histogram) > 1500
    with monkeypatch.context() as m:
        m.setattr(packing, "SCHEDULE", ((1.0, 1.0),))
        plan = packing_plan(histogram)
    with monkeypatch.context() as m:
        m.setattr(packing, "SCHEDULE", ((0.0, 1.0),))
        plain = packing_plan(histogram)
    with monkeypatch.context() as m:
        m.setattr(packing, "solve", lambda lengths, counts, capacity, *_: packing.Fraction({}, counts.sum(), lengths / capacity, float(lengths @ counts / capacity)))
        without = packing_plan(histogram)
    assert plan.from_configurations >= 0.8 * plan.sequences
    assert plan.sequences <= 0.985 * plain.sequences and plan.sequences <= 0.97 * fits and without.sequences == fits
    assert plan.sequences <= 1.02 * plan.bound


def test_solution_covers_all_within_its_bound():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 600, 150))
    counts = rng.integers(1, 60, len(lengths))
    found = solve(lengths, counts, 1000)
    covered = np.zeros(len(lengths))
    for config, uses in found.uses.items():
        assert uses > 0 and sum(int(lengths[i]) * k for i, k in config) <= 1000
        for i, k in config:
            covered[i] += uses * k
    assert np.allclose(covered, counts)
    assert found.bound <= found.sequences <= 1.03 * found.bound


def test_dual_bounds():
    assert packing_plan({600: 5, 700: 3}, 1000).bound == 8  # pieces of over half a sequence
    assert packing_plan({500: 7}, 1000)[1:] == (4, 4, 4)  # three full pairs and one alone
    # Three pieces of 334 don't fit: by tokens 34 sequences are enough, by the weights' best configuration 50 are needed.
    assert packing_plan({334: 100}, 1000).bound == packing_plan({334: 100}, 1000).sequences == 50
    assert packing_plan({1000: 4}, 1000)[1:] == (4, 4, 4)
    assert packing_plan({}, 1000)[1:] == (0, 0, 0)


@pytest.mark.parametrize("seed", range(3))
def test_knapsack_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths, limits, prices = np.array([3, 5, 7, 11]), rng.integers(1, 4, 4), rng.random(4)
    best = max(
        sum(prices * k) for k in product(*(range(n + 1) for n in limits)) if sum(lengths * k) <= 30
    )
    value, chosen = best_configuration(lengths, prices, limits, 30)
    assert value == pytest.approx(best) == pytest.approx(sum(prices[i] * k for i, k in chosen.items()))
    assert sum(lengths[i] * k for i, k in chosen.items()) <= 30 and all(k <= limits[i] for i, k in chosen.items())
