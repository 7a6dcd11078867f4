"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts. A byte costs -log2 of its share in the longest
context that has been seen, or an escape there and its cost in the next shorter one (method C: a context seen
n times with d different bytes escapes with probability d / (n + d)); below the empty context all 256 bytes
are alike. Statistics are frozen after training and nothing is excluded after an escape, so that a byte's
exact code length is a function of the bytes before it. The language with the shortest code for the whole
text wins.

The trees are learnt from a bounded sample of labelled documents (docs_per_language) and are broadcast;
their size is bounded by the sample, not by the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevier.llm.common import kept_names

UNKNOWN = "und"
#: Bytes scored at once, and rows taken from a batch at once: what bounds a task's memory.
SLICE = 1_000_000
ROWS = 500
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(buffer: np.ndarray, order: int) -> np.ndarray:
    """At each place from `order` on: the byte there and so many before it, as one number."""
    n = len(buffer) - order
    out = np.zeros(n, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | buffer[k : k + n]
    return out


class Trees:
    """Frozen context trees of all languages. counts: one row (lang, order, gram, n) for each context and byte."""

    def __init__(self, counts: pd.DataFrame, max_order: int):
        self.langs = sorted(counts["lang"].unique())
        self.max_order = max_order
        self.contexts, self.escapes, self.grams, self.bits = [], [], [], []
        width = len(self.langs)
        for order in range(max_order + 1):
            rows = counts[counts["order"] == order]
            gram = rows["gram"].to_numpy().astype(np.uint64)
            lang = np.searchsorted(self.langs, rows["lang"].to_numpy())
            n = rows["n"].to_numpy().astype(np.float64)
            contexts, at = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, (at, lang), n)
            np.add.at(kinds, (at, lang), 1)
            seen = kinds > 0
            escape = np.zeros_like(total)
            escape[seen] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
            distinct, place = np.unique(gram, return_inverse=True)
            bits = np.full((len(distinct), width), np.nan)
            bits[place, lang] = np.log2((total[at, lang] + kinds[at, lang]) / n)
            self.contexts.append(contexts)
            self.escapes.append(escape)
            self.grams.append(distinct)
            self.bits.append(bits)

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each gram of the highest order, by language."""
        bits = np.full((len(gram), len(self.langs)), 8.0)
        for order in range(self.max_order + 1):
            own = gram & np.uint64((1 << (8 * (order + 1))) - 1)
            for table, values, key, add in (
                (self.contexts[order], self.escapes[order], own >> np.uint64(8), True),
                (self.grams[order], self.bits[order], own, False),
            ):
                if not len(table):
                    continue
                at = np.minimum(np.searchsorted(table, key), len(table) - 1)
                hit = table[at] == key
                if add:
                    bits[hit] += values[at[hit]]
                else:
                    found = values[at[hit]]
                    bits[hit] = np.where(np.isnan(found), bits[hit], found)
        return bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        pad = b"\n" * self.max_order
        sizes = np.array([len(t) + self.max_order for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        buffer = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        owner_of = lambda at: np.searchsorted(starts, at, side="right") - 1
        for a in range(self.max_order, len(buffer), SLICE):
            b = min(len(buffer), a + SLICE)
            codes, distinct = pd.factorize(grams(buffer[a - self.max_order : b].astype(np.uint64), self.max_order))
            cost = self.cost(np.asarray(distinct, np.uint64))
            first, last = owner_of(a), owner_of(b - 1)
            edges = np.maximum(starts[first : last + 1], a) - a
            padding = np.concatenate([np.arange(s, min(s + self.max_order, b)) for s in starts[first : last + 1]] or [[]]).astype(np.int64)
            padding = padding[(padding >= a) & (padding < b)] - a
            for k in range(len(self.langs)):
                each = cost[:, k][codes]
                each[padding] = 0
                out[first : last + 1, k] += np.add.reduceat(each, edges)
        return out


def has_letter(raw: bytes) -> bool:
    return bool(ASCII_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def sampled(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, docs_per_language: int) -> DataFrame:
    """About docs_per_language documents of each language (lang, text), drawn by a hash of the id."""
    usable = learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    counts = {r["lang"]: r["n"] for r in docs.where(usable).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(scale, scale * docs_per_language // n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(scale)) < share
    return docs.where(usable & drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def train(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_order: int = 4,
    docs_per_language: int = 200,
) -> Trees:
    """Context trees from about docs_per_language of the labelled documents that `learn` allows."""

    def count(batches):
        for batch in batches:
            rows = pd.DataFrame({"lang": batch.column(0).to_pylist(), "text": batch.column(1).to_pylist()})
            for lang, own in rows.groupby("lang"):
                raw = b"".join(b"\n" * max_order + t.encode("utf-8", "surrogatepass") for t in own["text"])
                buffer = np.frombuffer(raw, np.uint8).astype(np.uint64)
                for order in range(max_order + 1):
                    gram, n = np.unique(grams(buffer, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), order, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)],
                        ["lang", "order", "gram", "n"],
                    )

    counted = (
        sampled(docs, learn, id_col, text_col, lang_col, docs_per_language)
        .mapInArrow(count, "lang string, order int, gram long, n long")
        .groupBy("lang", "order", "gram")
        .agg(F.sum("n").alias("n"))
    )
    return Trees(counted.toPandas(), max_order)


def identify(
    docs: DataFrame,
    trees: Trees,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, lang_pred, score, bits, *keep) for each row of docs.

    score is the winner's posterior under equal priors, bits its code length. A text that is null or has no
    letter, and any text if no language was learnt, is `und` with score 0. Of equal codes the language first
    in alphabetical order wins. A kept column that has the name of another result is kept_<name>.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    extra = [c for c in keep if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(extra)])
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    place = {id_col: 0, text_col: 1} | {c: k + 2 for k, c in enumerate(extra)}
    kept = [place[c] for c in keep]
    told = kept_names(keep, ("id", "lang_pred", "score", "bits"))
    names = ["id", "lang_pred", "score", "bits", *told]

    def run(batches):
        model = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
                chosen = [i for i, t in enumerate(raw) if model.langs and has_letter(t)]
                langs, scores, best = [UNKNOWN] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
                if chosen:
                    bits = model.code_lengths([raw[i] for i in chosen])
                    least = bits.min(1)
                    odds = np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
                    for i, k, s, b in zip(chosen, bits.argmin(1), 1 / odds, least, strict=True):
                        langs[i], scores[i], best[i] = model.langs[k], s, b
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(best), *[part.column(k) for k in kept]],
                    names,
                )

    others = "".join(f", `{c}` {kinds[k]}" for c, k in zip(told, kept, strict=True))
    return rows.mapInArrow(run, f"id {kinds[0]}, lang_pred string, score double, bits double{others}")
