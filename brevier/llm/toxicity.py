"""Toxicity by weak supervision.

Voters: words of a lexicon, word beginnings, and typographic patterns; each says that a text is toxic, loudly if
it hits often, or abstains. One more voter speaks where no word or beginning hits, or a single one. Beginnings
are those much more frequent in the toxic texts among two thirds of a bounded sample of labelled rows.

A generative label model takes the votes of a bounded sample of texts, whose labels it does not see, as noisy
witnesses of a hidden class. Expectation maximisation estimates the class balance, each voter's rates under
either class, and the correlations among voters of one class, by which votes that say the same thing are
discounted. The other third of the labelled rows anchors balance and rates: it counts in the maximisation with
its labels. A linear classifier is trained on the posterior labels and scores every text. What is learnt is
bounded by max_labelled and max_texts rows and max_patterns patterns, not by the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevier.llm.common import cut

# Seed lexicon.
LEXICON = (
    "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown clowns dumb "
    "filthy garbage vermin imbecile crap jerk bastard freak ugly hate"
).split()
SHORTEST, LONGEST = 4, 8
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
CACHE = 300_000
#: Typographic voters: share of capitals, runs of exclamation marks, second-person address.
TYPOGRAPHY = ("capitals", "shouting", "address")
ADDRESS = re.compile(r"\byou(?:'re| are) (?:a|an|such|so)\b", re.IGNORECASE)
CAPITAL_RUN = re.compile(r"\b[A-Z]{4,}\b")


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]


class Voters:
    """Counts of each voter's hits in a text."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.names = [f"word:{w}" for w in LEXICON] + [f"begins:{p}" for p in patterns] + list(TYPOGRAPHY)
        self.words = {w: k for k, w in enumerate(LEXICON)}
        self.starts = {p: len(LEXICON) + k for k, p in enumerate(patterns)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def of_word(self, raw: str) -> tuple[int, ...]:
        word = EDGE.sub("", raw)
        found = [self.starts[b] for b in beginnings(word) if b in self.starts]
        if word in self.words:
            found.append(self.words[word])
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache[raw] = out = tuple(found)
        return out

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        out = np.zeros(len(self.names), np.float32)
        text = text or ""
        words = text.lower().split()
        known = self.cache
        for w, hit in zip(words, map(known.get, words), strict=True):
            if hit is None:
                hit = self.of_word(w)
            for k in hit:
                out[k] += 1
        out[-3] = len(CAPITAL_RUN.findall(text))
        out[-2] = text.count("!!")
        out[-1] = len(ADDRESS.findall(text))
        return out, len(words)


def votes_of(counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A vote of each voter: 0 abstains, 1 hits once, 2 hits more often.

    The last voter counts the hits of all words and beginnings: 1 says none, 2 says a single one. A beginning
    abstains if its hit is the single one, which the last voter judges.
    """
    votes = np.minimum(counts, 2).astype(np.int8)
    total = counts[:, groups < 2].sum(1)
    votes[np.ix_(total == 1, groups == 1)] = 0
    return np.hstack([votes, np.where(total > 1, 0, total + 1)[:, None]]).astype(np.int8)


def features_of(counts: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: presence, number and density of hits of each voter and of all lexicon or pattern voters."""
    total = np.stack([counts[:, groups == g].sum(1) for g in (0, 1)], 1)
    every = np.hstack([counts, total])
    density = np.minimum(100 * every / np.maximum(sizes, 20)[:, None], 10)
    return np.hstack([every > 0, np.log1p(every), density, np.log1p(sizes)[:, None] / 10])


#: What voters count as having seen beforehand, (texts, share of them hit): toxic and clean texts, by group of voters.
PRIORS = {0: ((10, 0.1), (100, 0.005)), 1: ((10, 0.02), (10, 0.02)), 2: ((10, 0.02), (10, 0.02))}
#: The last voter likewise, for its votes that no word or beginning hits and that a single one does.
FEW = ((10, (0.2, 0.1)), (10, (0.8, 0.1)))
#: The class balance likewise.
BALANCE = (10, 0.1)


def one_hot(votes: np.ndarray) -> np.ndarray:
    """(text, kind and voter): whether it votes 1, 2 or, as the third kind, abstains."""
    return np.hstack([votes == kind for kind in (1, 2, 0)]).astype(float)


def first_groups(votes: np.ndarray, subclasses: int) -> np.ndarray:
    """Shares of a class's groups that a text starts with: by how many voters hit, so that the groups differ."""
    many = np.minimum(np.maximum((votes[:, :-1] > 0).sum(1) - 1, 0), subclasses - 1)
    out = np.full((len(votes), subclasses), 1.0)
    out[np.arange(len(votes)), many] = 9.0
    return out / out.sum(1, keepdims=True)


def shares_of(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def label_model(
    votes: np.ndarray, gold_votes: np.ndarray, gold: np.ndarray, groups: np.ndarray, gold_weight: float = 10.0, rounds: int = 100, subclasses: int = 2
) -> tuple[np.ndarray, dict]:
    """Posterior probability of the toxic class for each row of votes, and the estimates.

    gold_votes and gold (0 or 1) are the votes and labels of other rows, which count with their labels, each as
    gold_weight texts: they keep the hidden class from drifting to another meaning. The likelihood of a text is the
    balance of its class times the share of its group there times the rates of its votes in that group, abstentions
    included; class and group are hidden. Arrays of groups have those of the toxic class first.
    """
    n, classes = votes.shape[1], np.repeat([0, 1], subclasses)
    mass = np.array([[PRIORS[g][c][0] for g in groups] + [FEW[c][0]] for c in (0, 1)], float)
    # A voter's votes 1 and 2 are taken to be as likely beforehand, but for the last one's.
    rates = [np.array([[PRIORS[g][c][1] / 2 for g in groups] + [FEW[c][1][j]] for c in (0, 1)], float) for j in (0, 1)]
    prior = np.hstack([mass * rates[0], mass * rates[1], mass * (1 - rates[0] - rates[1])])[classes] / subclasses
    hits, gold_hits = one_hot(votes), one_hot(gold_votes)
    allowed = np.stack([gold == 1, gold == 0], 1)[:, classes]
    held = gold_weight * allowed * np.tile(first_groups(gold_votes, subclasses), 2)
    side, post = np.zeros((len(votes), 2 * subclasses)), np.zeros(len(votes))
    for k in range(rounds + 1):
        total = side.sum(0) + held.sum(0)
        toxic = total[classes == 0].sum()
        balance = float((toxic + BALANCE[0] * BALANCE[1]) / (total.sum() + BALANCE[0]))
        share = np.concatenate([(total[classes == c] + 1) / (total[classes == c] + 1).sum() for c in (0, 1)])
        count = side.T @ hits + held.T @ gold_hits + prior
        rate = count / np.tile(count.reshape(2 * subclasses, 3, n).sum(1), 3)
        estimates = {"balance": balance, "share": share, "rate": np.maximum(rate, 1e-9), "subclasses": subclasses}
        if k == rounds or not len(votes):
            break
        score = scores(hits, estimates)
        if k == 0:
            both = shares_of(score)
            side = np.stack([both[:, classes == c].sum(1) for c in (0, 1)], 1)[:, classes] * np.tile(first_groups(votes, subclasses), 2)
        else:
            side = shares_of(score)
        if len(gold):
            held = gold_weight * shares_of(np.where(allowed, scores(gold_hits, estimates), -1e9))
        before, post = post, side[:, classes == 0].sum(1)
        if k and np.abs(post - before).max() < 1e-4:
            break
    return post, estimates


def scores(hits: np.ndarray, estimates: dict) -> np.ndarray:
    """Logarithm of the likelihood of each text (one-hot votes) with each group of either class."""
    balance = np.repeat([estimates["balance"], 1 - estimates["balance"]], estimates["subclasses"])
    return hits @ np.log(estimates["rate"]).T + np.log(balance * estimates["share"])


def log_likelihood(votes: np.ndarray, estimates: dict) -> float:
    """Mean logarithm of the likelihood of votes under the estimates."""
    score = scores(one_hot(votes), estimates)
    most = score.max(1)
    return float((most + np.log(np.exp(score - most[:, None]).sum(1))).mean())


def correlations(estimates: dict, toxic: bool = False) -> np.ndarray:
    """Correlations of the voters' hits within a class, as its groups make them."""
    k = estimates["subclasses"]
    own = slice(0, k) if toxic else slice(k, 2 * k)
    rate, share = estimates["rate"][own], estimates["share"][own]
    n = rate.shape[1] // 3
    hit = rate[:, :n] + rate[:, n : 2 * n]
    mean = share @ hit
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    found = ((hit - mean).T * share) @ (hit - mean) / np.outer(spread, spread)
    np.fill_diagonal(found, 1)
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def drawn(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """About `most` rows, drawn by a hash of their id."""
    scale = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(scale)) < min(scale, scale * most // max(1, rows.count())))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_id: str, label_col: str, max_labelled: int, max_anchors: int
) -> DataFrame:
    """(text, y, mine) of about max_labelled of the labelled rows that `learn`, on column id, allows; all but about
    max_anchors of them, or a third if they are fewer than three times as many, to mine."""
    usable = labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & learn)
    one = cut(drawn(usable, max_labelled, "sample").groupBy("id").agg(F.max("y").alias("y")))
    third = max(3.0, one.count() / max_anchors)
    one = one.withColumn("mine", F.pmod(F.xxhash64(F.lit("mine"), "id"), F.lit(1 << 20)) >= int((1 << 20) / third))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample has a bounded number of rows of three small values each.
    return texts.join(F.broadcast(one), "id").select("text", "y", "mine")


def mine_patterns(sample: DataFrame, max_patterns: int, min_precision: float, significance: float) -> list[str]:
    """Word beginnings most typical of the toxic texts of the sample, by the likelihood ratio of their 2 x 2 table.

    Significance is the least ratio (G squared). Chance gives one of some 300,000 beginnings 25; those that three toxic
    texts and hardly a clean one have are far fewer.
    """
    sizes = {r["y"]: r["n"] for r in sample.groupBy(F.when(F.col("y") == 1, 1).otherwise(0).alias("y")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {EDGE.sub("", w) for w in (text or "").lower().split()}
                seen[int(y == 1)].update({b for w in words for b in beginnings(w)})
        rows = [(b, y, n) for y, counter in seen.items() for b, n in counter.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
            ["start", "y", "n"],
        )

    bad, good = F.col("bad"), F.col("good")
    base = toxic / (toxic + clean)
    cell = lambda n, of, share: F.when(n > 0, n * F.log(n / (of * share))).otherwise(0.0)
    hit, missed = bad + good, toxic + clean - bad - good
    ratio = 2 * (cell(bad, hit, base) + cell(good, hit, 1 - base) + cell(toxic - bad, missed, base) + cell(clean - good, missed, 1 - base))
    counted = (
        sample.mapInArrow(count, "start string, y int, n long")
        .groupBy("start")
        .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
        .where((bad > 2) & (bad >= min_precision * (hit + 1)))
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= significance)
        .orderBy(F.desc(bad * bad / (hit + 1)), F.desc(F.length("start")), "start")
        .limit(10 * max_patterns)
        .collect()
    )
    chosen: list[str] = []
    for r in counted:  # one voter for each family of beginnings, none that only repeats the lexicon
        if len(chosen) < max_patterns and not any(x.startswith(r["start"]) or r["start"].startswith(x) for x in [*LEXICON, *chosen]):
            chosen.append(r["start"])
    return sorted(chosen)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    max_labelled: int = 12_000,
    max_anchors: int = 300,
    max_texts: int = 8_000,
    max_patterns: int = 80,
    min_precision: float = 0.3,
    significance: float = 18.0,
    model: Callable = label_model,
) -> dict:
    """A model from about max_labelled labelled rows and max_texts texts. learn is a condition on a column `id`.

    Rows that `learn` does not allow give neither labels nor texts. Without labels the lexicon alone votes.
    """
    sample = cut(labelled_sample(docs, labels, learn, id_col, text_col, label_id, label_col, max_labelled, max_anchors))
    mined = sample.where("mine")
    voters = Voters(mine_patterns(mined, max_patterns, min_precision, significance))
    groups = np.array([0] * len(LEXICON) + [1] * len(voters.patterns) + [2] * len(TYPOGRAPHY))

    def count(batches):
        for batch in batches:
            found = [voters.counts(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.tolist() for c, _ in found], pa.list_(pa.float32())), pa.array([n for _, n in found], pa.int64()), batch.column(1).cast(pa.float64())],
                ["counts", "size", "y"],
            )

    def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found: pd.DataFrame = rows.mapInArrow(count, "counts array<float>, size long, y double").toPandas()
        listed = np.stack(found["counts"].to_numpy()) if len(found) else np.zeros((0, len(groups)))
        return listed.astype(float), found["size"].to_numpy(float), found["y"].to_numpy(float)

    texts = drawn(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learn), max_texts, "texts")
    counts, sizes, _ = counted(texts.select("text", F.lit(None).cast("double").alias("y")))
    gold_counts, _, gold = counted(sample.where("not mine").select("text", "y"))
    post, estimates = model(votes_of(counts, groups), votes_of(gold_counts, groups), gold, groups)
    weights = logistic(features_of(counts, sizes, groups), post)
    return {"patterns": voters.patterns, "groups": groups, "weights": weights, "model": estimates}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs: the probability that the text is toxic.

    Null and empty texts get the score of a text without hits. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("patterns", "groups", "weights")})

    def run(batches):
        known = shared.value
        voters = Voters(known["patterns"])
        weights = known["weights"]
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                found = [voters.counts(t.as_py()) for t in part.column(1)]
                counts = np.stack([c for c, _ in found]).astype(float)
                x = features_of(counts, np.array([n for _, n in found], float), known["groups"])
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.round(12))], ["id", "score"])  # sums differ by batch in the last digits

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
