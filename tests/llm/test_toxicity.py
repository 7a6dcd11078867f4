import random

import numpy as np
import pytest

from brevier.llm.common import held_out
from brevier.llm.toxicity import BALANCE, FEW, PRIORS, correlations, label_model, log_likelihood, score, train


def made(rng, n, accuracies):
    """Hidden classes and votes (0, 1, 2; the last voter speaks where none hits) of independent voters."""
    y = rng.random(n) < 0.2
    hits = np.stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in accuracies], 1)
    votes = hits * np.where(rng.random(hits.shape) < 0.5, 1, 2)
    total = votes.sum(1)
    return y, np.hstack([votes, np.where(total > 1, 0, total + 1)[:, None]]).astype(np.int8)


def brute_force(votes, gold_votes, gold, groups, gold_weight, rounds, subclasses):
    """The same estimates, one text and one vote at a time."""
    n, cells = votes.shape[1], [(y, k) for y in (1, 0) for k in range(subclasses)]
    prior = lambda j, y, v: (PRIORS[groups[j]][1 - y][0], PRIORS[groups[j]][1 - y][1] / 2) if j < n - 1 else (FEW[1 - y][0], FEW[1 - y][1][v - 1])

    def first(row):
        many = min(max(sum(v > 0 for v in row[:-1]) - 1, 0), subclasses - 1)
        return [(9 if k == many else 1) / (8 + subclasses) for k in range(subclasses)]

    known = [{(y, k): (y == z) * s for y in (1, 0) for k, s in enumerate(first(row))} for row, z in zip(gold_votes, gold, strict=True)]
    hidden = [dict.fromkeys(cells, 0.0) for _ in votes]
    for step in range(rounds + 1):
        rows = [(row, {c: gold_weight * q for c, q in own.items()}) for row, own in zip(gold_votes, known, strict=True)] + list(zip(votes, hidden, strict=True))
        total = {c: sum(own[c] for _, own in rows) for c in cells}
        toxic = sum(total[1, k] for k in range(subclasses))
        balance = (toxic + BALANCE[0] * BALANCE[1]) / (sum(total.values()) + BALANCE[0])
        share = {(y, k): (total[y, k] + 1) / (sum(total[y, i] for i in range(subclasses)) + subclasses) for y, k in cells}
        rate = {}
        for y, k in cells:
            for j in range(n):
                count = {}
                for v in (1, 2, 0):
                    m, p = prior(j, y, v) if v else (prior(j, y, 1)[0], 1 - prior(j, y, 1)[1] - prior(j, y, 2)[1])
                    count[v] = sum(own[y, k] for row, own in rows if row[j] == v) + m * p / subclasses
                for v in count:
                    rate[y, k, j, v] = count[v] / sum(count.values())
        if step == rounds:
            break

        def likely(row, of=None):
            out = {c: (balance if c[0] else 1 - balance) * share[c] * np.prod([rate[*c, j, v] for j, v in enumerate(row)]) * (of is None or c[0] == of) for c in cells}
            return {c: x / sum(out.values()) for c, x in out.items()}

        hidden = [likely(row) for row in votes]
        if step == 0:
            hidden = [{(y, k): sum(own[y, i] for i in range(subclasses)) * first(row)[k] for y, k in cells} for row, own in zip(votes, hidden, strict=True)]
        known = [likely(row, z) for row, z in zip(gold_votes, gold, strict=True)]
    return [sum(own[1, k] for k in range(subclasses)) for own in hidden], balance, share


@pytest.mark.parametrize("subclasses", [1, 2, 3])
def test_label_model_against_brute_force(subclasses):
    rng = np.random.default_rng(3)
    y, votes = made(rng, 120, [(0.7, 0.05), (0.5, 0.02), (0.6, 0.3)])
    votes = np.hstack([votes[:, 2:3], votes])  # two voters that always agree, in many clean texts too
    gold_y, gold_votes = made(rng, 15, [(0.7, 0.05), (0.5, 0.02), (0.6, 0.3)])
    gold_votes = np.hstack([gold_votes[:, 2:3], gold_votes])
    groups = np.array([1, 0, 0, 1])
    post, estimates = label_model(votes, gold_votes, gold_y.astype(float), groups, rounds=6, subclasses=subclasses)
    wanted, balance, share = brute_force(votes, gold_votes, gold_y.astype(int), groups, 10.0, 6, subclasses)
    assert np.allclose(post, wanted, atol=1e-4) and np.allclose(estimates["share"], [share[y, k] for y in (1, 0) for k in range(subclasses)], atol=1e-4)
    assert abs(estimates["balance"] - balance) < 1e-4  # the model stops where posteriors move by less


def test_correlated_voters_are_no_independent_witnesses():
    """Six voters that hit together in one clean text of ten, and three weaker ones that tell the class."""
    rng = np.random.default_rng(5)

    def drawn(n):
        y = rng.random(n) < 0.2
        theme = rng.random(n) < np.where(y, 0.3, 0.1)
        hits = np.stack([rng.random(n) < np.where(theme, 0.9, 0.01) for _ in range(6)] + [rng.random(n) < np.where(y, 0.7, 0.05) for _ in range(3)], 1)
        total = hits.sum(1)
        return y, np.hstack([hits, np.where(total > 1, 0, total + 1)[:, None]]).astype(np.int8)

    (y, votes), (gold_y, gold_votes), (_, other) = drawn(4000), drawn(200), drawn(1000)
    found = {k: label_model(votes, gold_votes, gold_y.astype(float), np.ones(9, int), subclasses=k) for k in (1, 2)}
    wrong = {k: ((post > 0.5) != y).mean() for k, (post, _) in found.items()}
    assert wrong[2] < 0.65 * wrong[1]
    likely = {k: log_likelihood(other, estimates) for k, (_, estimates) in found.items()}
    assert likely[2] > likely[1] + 0.5
    real = np.corrcoef((votes[~y] > 0).T[:9])
    assert np.abs(correlations(found[2][1])[:9, :9] - real).max() < 0.15 and real[0, 1] > 0.6


def test_held_out_toxicity_of_real_tables(spark):
    """Ablations: groups within classes make held-out votes likelier, anchors give the class its meaning."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.repartition(8)
    seen = {}

    def model(votes, gold_votes, gold, groups):
        cut = len(votes) // 3
        for name, k, rounds in (("full", 2, 100), ("independent", 1, 100), ("one round", 2, 1)):
            seen[name] = log_likelihood(votes[:cut], label_model(votes[cut:], gold_votes, gold, groups, rounds=rounds, subclasses=k)[1])
        seen["anchors"] = len(gold)
        return label_model(votes, gold_votes, gold, groups)

    own = held_out("doc_id", 4, 2)
    found = score(docs.where(own), train(docs, labels, ~held_out("id", 4, 2), model=model)).join(labels.withColumnRenamed("doc_id", "id"), "id").where("toxic is not null").collect()
    hit = sum(r.score >= 0.3 and r.toxic == 1 for r in found)
    f1 = 2 * hit / (sum(r.score >= 0.3 for r in found) + sum(r.toxic == 1 for r in found))
    assert len(found) > 900 and f1 >= 0.9 and seen["anchors"] < 400
    assert seen["full"] > seen["independent"] + 0.2 and seen["full"] > seen["one round"] + 0.01


def test_label_model_finds_the_hidden_class_better_than_counting_votes():
    rng = np.random.default_rng(0)
    voters = [(0.6, 0.01)] * 4 + [(0.4, 0.3)] * 6  # four good voters and six bad ones
    y, votes = made(rng, 4000, voters)
    gold_y, gold_votes = made(rng, 60, voters)
    post, _ = label_model(votes, gold_votes, gold_y.astype(float), np.ones(10, int))
    wrong = ((post > 0.5) != y).mean()
    majority = min(((votes[:, :-1] > 0).sum(1) >= k).__ne__(y).mean() for k in range(1, 8))
    assert wrong < 0.06 and wrong < 0.6 * majority
    never = np.full(len(gold_y), 0.0)
    blind, _ = label_model(votes[:0], gold_votes, never, np.ones(10, int))
    assert len(blind) == 0


def test_held_out_accuracy_and_edge_cases(spark, nasty, empty):
    rng = random.Random(1)
    clean = ["house", "river", "stone", "walks", "light", "garden", "evening"]
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        words = [rng.choice(clean) for _ in range(40)]
        if bad:
            words[7] = rng.choice(["idiot", "grumblefoo", "grumblebar,", "Grumblebaz"])
            words[20] = rng.choice(["moron", "grumblequx"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = train(docs, marks, ~held_out("id", 4, 2))
    assert any("grumble".startswith(p[:7]) for p in model["patterns"])
    found = score(docs, model).where(held_out("id", 4, 2)).collect()
    assert len(found) > 50 and all((r.score >= 0.3) == (r.id % 5 == 0) for r in found)

    def counted(votes, gold_votes, gold, groups):  # in place of the label model: a text with more than two votes is toxic
        return ((votes[:, :-1] > 0).sum(1) > 2).astype(float), {}

    other = score(docs, train(docs, marks, ~held_out("id", 4, 2), model=counted)).where(held_out("id", 4, 2)).collect()
    assert any((r.score >= 0.3) != (r.id % 5 == 0) for r in other)
    got = score(nasty, model).collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 for r in got)
    odd = [(1, "You are an IDIOT!! " + "quiet words " * 30_000), (2, "moron"), (2, "moron"), (None, "moron"), (3, None), (4, "")]
    by = sorted(((r.id, r.score) for r in score(spark.createDataFrame([(*r, 0.5) for r in odd], "doc_id long, text string, score double"), model).collect()), key=repr)
    assert len(by) == 6 and by[1] == by[2] and by[1][1] == by[5][1] and by[3][1] == by[4][1]  # alike texts are scored alike, null as empty
    assert score(empty, model).count() == 0
    # Without labels the lexicon alone votes.
    alone = {r.id: r.score for r in score(docs, train(docs, marks.limit(0), ~held_out("id", 4, 2))).collect()}
    text = dict(rows)
    assert all((alone[k] >= 0.3) == ("idiot" in text[k] or "moron" in text[k]) for k in alone)
    assert train(empty, marks, ~held_out("id", 4, 2))["patterns"] == []
