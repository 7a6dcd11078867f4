"""Spelling variants: words one insertion, deletion or replacement apart, and for each word the common form it may stand for.

Two words are one edit apart if both become the same text when one character at the same place is left out, or if one
becomes the other when a character is left out. So every word has a key for itself and for each of its deletions: polynomial
hashes of prefix and suffix give all of a word's keys at once, as NumPy integers for all words of a length. The keys are
dealt by their leading bits, sorted, and those that only one word has are dropped; what is left is verified on the texts.

Words are never paired: those that share a deletion at one place all are one edit apart, so that a group's size and its two
most frequent words tell each member's neighbours; a deletion that is itself a word has one such word. Work and rows grow
with the number of deletions, whatever the size of a group.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevier.llm.common import cut

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Distinct words that a task counts before it hands them on.
MOST_WORDS = 200_000
#: Characters whose keys are made at a time.
MOST_CHARACTERS = 1_000_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, damage: int = 0) -> DataFrame:
    """(word, n) of all runs of at least `least` letters, A to Z and U+00C0 to U+00FF, with A to Z in lower case.

    Texts are counted whole; null has no words. damage: a run whose CRC-32, of `<id>:<run>`, is a multiple of it loses the
    character at that hash modulo its length, as a typist might have left it out; 0, or a null id, damages none.
    """
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def words_of(name, text: str) -> Counter:
        # One byte a character: those beyond Latin-1 are no letters here, and bytes have A to Z alone in lower case.
        found = Counter(runs.findall(text.encode("latin-1", "replace").lower()))
        if not damage or name is None:
            return found
        out: Counter = Counter()
        head = zlib.crc32(f"{name}:".encode())
        for run, n in found.items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
            at = h % len(run) if h % damage == 0 else len(run)
            out[run[:at] + run[at + 1 :]] += n
        return out

    def run(batches):
        counts: Counter = Counter()

        def batch_of():
            words = [w for w in counts if len(w) >= least]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    counts.update(words_of(name.as_py(), text.as_py()))
                    if len(counts) > MOST_WORDS:
                        yield batch_of()
                        counts.clear()
        yield batch_of()

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers, so that their leading bits are even."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words of one length, given as rows of code points: of each word, and of it without its k-th character."""
    n, length = letters.shape
    values = mixed(letters.astype(np.uint64) + np.uint64(1))
    prefix = np.zeros((length + 1, n), np.uint64)
    suffix = np.zeros((length + 1, n), np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, BASE)]), dtype=np.uint64)
    for k in range(length):
        prefix[k + 1] = prefix[k] * BASE + values[:, k]
        suffix[length - 1 - k] = suffix[length - k] + values[:, length - 1 - k] * power[k]
    without = prefix[:-1] * power[length - 1 :: -1][:length, None] + suffix[1:]
    return mixed(prefix[-1]), mixed(without).T


def keys_of(words: list[str], ids: np.ndarray):
    """(key, id, place, first) arrays of all words: place -1 for the word itself, else of the character left out.

    first: the character differs from the one before it. Leaving out either of two equal neighbours gives one text.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == length)
        step = max(1, MOST_CHARACTERS // max(1, length))
        for low in range(0, len(own), step):
            part = own[low : low + step]
            joined = "".join(words[k] for k in part.tolist()).encode("utf-32-le", "surrogatepass")
            letters = np.frombuffer(joined, "<u4").reshape(len(part), length)
            whole, without = deletion_keys(letters)
            first = np.ones(letters.shape, bool)
            first[:, 1:] = letters[:, 1:] != letters[:, :-1]
            yield whole, ids[part], np.full(len(part), -1, np.int32), np.ones(len(part), bool)
            yield without.ravel(), np.repeat(ids[part], length), np.tile(np.arange(length, dtype=np.int32), len(part)), first.ravel()


def keyed(words: DataFrame) -> DataFrame:
    """(key, id, place, first) of words (id, word)."""

    def run(batches):
        for batch in batches:
            for columns in keys_of(batch.column(1).to_pylist(), batch.column(0).to_numpy()):
                key, *rest = columns
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, rest)], ["key", "id", "place", "first"])

    return words.select("id", "word").mapInArrow(run, "key long, id long, place int, first boolean")


def shared_keys(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose key and place another row has, and rows whose key both a word and another word's deletion have."""
    order = np.lexsort((place, key))
    key, place, first = key[order], place[order], first[order]
    if not len(order):
        return order, order
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_pair = new_key | np.concatenate([[True], place[1:] != place[:-1]])
    alone = new_pair & np.concatenate([new_pair[1:], [True]])
    group = np.cumsum(new_key) - 1
    whole = place < 0
    has_whole = np.bincount(group, whole) > 0
    has_part = np.bincount(group, ~whole) > 0
    return order[~alone & ~whole], order[(has_whole & has_part)[group] & (whole | first)]


def candidates(keys: DataFrame, n_keys: int, per_part: int = 500_000) -> DataFrame:
    """(id, place, same) of rows that share their key: same tells that they share the place as well.

    Keys are dealt by their leading bits, so that a part has about per_part of them, whatever their number.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_keys) / per_part)))
    part = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)

    def run(batches):
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not held:
            return
        key, ids, place, first = (np.concatenate(c) for c in zip(*held, strict=True))
        for same, rows in zip((True, False), shared_keys(key, place, first.astype(bool)), strict=True):
            for low in range(0, len(rows), 100_000):
                at = rows[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(place[at]), pa.array(np.full(len(at), same))], ["id", "place", "same"])

    return keys.repartitionById(1 << bits, part).mapInArrow(run, "id long, place int, same boolean")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<n, word>) of words (id, word, n) that have a word one edit apart: the most frequent such."""
    n_keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    rows = candidates(keyed(words), n_keys).join(words, "id")
    whole = F.col("place") < 0
    left = F.expr("CASE WHEN place < 0 THEN word ELSE concat(substring(word, 1, place), substring(word, place + 2)) END")
    rows = rows.select("word", "n", whole.alias("whole"), F.when(F.col("same"), F.col("place")).otherwise(-1).alias("place"), left.alias("left"))
    group = Window.partitionBy("left", "place")
    order = group.orderBy("whole", F.desc("n"), "word")
    own = F.struct("n", "word")
    met = rows.select(
        "word",
        "whole",
        (F.col("place") >= 0).alias("same"),
        F.count("*").over(group).alias("size"),
        F.max(F.when(F.col("whole"), own)).over(group).alias("shorter"),
        F.first(own).over(order).alias("most"),
        F.lead(own).over(order).alias("next"),
        F.row_number().over(order).alias("rank"),
    )
    near = F.when(F.col("same") | F.col("whole"), F.col("size") - 1).otherwise(F.col("shorter").isNotNull().cast("long"))
    best = (
        F.when(F.col("same") & (F.col("rank") == 1), F.col("next"))
        .when(F.col("same") | (F.col("whole") & (F.col("size") > 1)), F.col("most"))
        .when(~F.col("whole"), F.col("shorter"))
    )
    each = met.select("word", near.alias("near"), F.when(best.isNotNull(), F.struct((-best["n"]).alias("n"), best["word"].alias("word"))).alias("best"))
    return each.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).where("n_near > 0")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms. A chain of n steps takes log2 n rounds."""
    roots, moved = forms.select("word", F.col("form").alias("root")), 1
    while moved:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = roots.where("moved").count()
        roots = roots.drop("moved")
    return roots


def spelling_variants(words: DataFrame, least: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of (word, n) of at least so many characters and occurrences.

    n_near: the number of words one inserted, deleted or replaced code point apart; form: the most frequent of these (ties:
    the first in code-point order) if it occurs `ratio` times as often as the word, or more, else null; root: the end of
    the chain of forms, the word itself if it has none. ratio must be over 1, so that chains end. Rows of one word are
    added up; a null word is no word. Words of any length and any characters are taken.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    counts = words.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    known = cut(counts.withColumn("id", F.monotonically_increasing_id()))
    judged = cut(
        known.drop("id")
        .join(neighbours(known), "word", "left")
        .withColumn("__taken", -F.col("best.n") >= ratio * F.col("n"))
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("__taken"), F.col("best.word")).alias("form"),
            F.when(F.col("__taken"), -F.col("best.n")).alias("form_n"),
        )
    )
    roots = followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
