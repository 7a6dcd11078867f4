"""Best-fit packing by a configuration linear program over the length histogram.

Token counts are cut to the sequence length, so that a histogram of at most `capacity` classes says all there
is to know about how pieces fit, whatever the size of the corpus. The configuration LP (a variable for each
way to fill a sequence, a covering row for each length) is solved by multiplicative weights, with a knapsack
dynamic program to price out configurations and a dual bound that tells how good the solution is. Its tight
configurations are rounded to whole sequences, what is left is solved again, and only what no further round
places goes to best-fit decreasing. The plan has a bounded number of rows and is broadcast; each piece finds its
place from its length and its rank among the pieces of that length. Ranks are counted in salted buckets.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevier.llm.common import cut

CACHE = 300_000


#: Latin letters that lower-case and normalise one by one, then punctuation that never joins letters.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordCache(dict):
    """Token ids of white-space delimited words: the tokenizer never looks across white space.

    A plain word is the tokens of its lower-cased letters and those of its punctuation, which its vocabulary
    encodes without the costly normalisation; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = byte_characters()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.runs: dict[str, list[int]] = {}
        self.new_ids, self.new_sizes = array("I"), array("q")
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(self, text: str) -> list[int]:
        """Ids of one run of lower-case letters or of punctuation."""
        if (ids := self.runs.get(text)) is None:
            known = text if text.isascii() else text.encode().decode("latin-1").translate(self.table)
            ids = [t.id for t in self.model.tokenize(known)]
            self.runs[text] = ids
        return ids

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if m := PLAIN.fullmatch(text):
            ids = self.run(m[1].lower())
            if m[2]:
                ids = ids + self.run(m[2])
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.new_ids.extend(ids)
        self.new_sizes.append(len(ids))
        self[word] = place = len(self)
        return place

    def settle(self) -> None:
        """Take in the words met since the last call."""
        if not self.new_sizes:
            return
        sizes = np.array(self.new_sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.array(self.new_ids, np.uint32)])
        self.new_ids, self.new_sizes = array("I"), array("q")

    def codes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[codes] - (ends - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each row of docs.

    A document is its token ids and then end_id; documents longer than capacity are cut into pieces of that
    length, the last of which may be shorter. A null or empty text is the end id alone.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        cache = WordCache(tokenizer_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                if len(cache) > CACHE:
                    cache.reset()
                part = batch.slice(low, 500)
                coded = [cache.codes(t.as_py()) for t in part.column(1)]
                cache.settle()
                rows, at, ids = [], [], []
                for k, codes in enumerate(coded):
                    tokens = np.append(cache.tokens(codes), np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), capacity)):
                        own = tokens[start : start + capacity]
                        rows.append((piece, start, len(own), zlib.crc32(own.tobytes())))
                        at.append(k)
                        if with_ids:
                            ids.append(own.astype(np.int32))
                if not rows:
                    continue
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    )


def best_configuration(lengths: np.ndarray, prices: np.ndarray, limits: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Knapsack dynamic program: the greatest price that fills one sequence, and the filling {place: times}."""
    value = np.zeros(capacity + 1)
    steps = []
    for i, length in enumerate(lengths.tolist()):
        left, size = min(int(limits[i]), capacity // length), 1
        while left > 0:
            take = min(size, left)
            room = length * take
            better = value[:-room] + prices[i] * take
            steps.append((i, take, room, better > value[room:]))
            value[room:] = np.maximum(value[room:], better)
            left, size = left - take, size * 2
    at, chosen = capacity, defaultdict(int)
    for i, take, room, used in reversed(steps):
        if at >= room and used[at - room]:
            chosen[i] += take
            at -= room
    return float(value[capacity]), dict(chosen)


class Fraction(NamedTuple):
    """A fractional solution that covers each piece once, its number of sequences, and dual prices of the lengths.

    No sequence holds pieces of a price of more than 1, so that the price of all pieces is a lower bound.
    """

    uses: dict[tuple[tuple[int, int], ...], float]
    sequences: float
    dual: np.ndarray
    bound: float


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float = 1.0, step: float = 1.0, block: int = 32) -> Fraction:
    """The configuration LP by multiplicative weights.

    The weight of a length starts at the length itself, a little more for longer ones as these are harder to
    place, and falls by exp(-rate) as its pieces are covered, so that lengths that lag behind the others are worth more.
    A round prices out one configuration for each block of `block` open lengths, drawn anew each time, and uses it, in
    fractions too, until it has covered `step` of its scarcest length or one is covered in full. It ends when all are
    covered. Dual prices are the best of tokens, pieces of over half a sequence, and the weights, at rounds 1, 2, 4, ...
    and on average over the rounds, over the price of their best configuration of all lengths.
    """
    random = np.random.default_rng(1)
    base = lengths * (1 + 0.02 * lengths / capacity)
    left, uses = counts.astype(float), defaultdict(float)
    duals, round_, total = [lengths / capacity, (2 * lengths > capacity).astype(float)], 0, np.zeros(len(lengths))
    while len(open_ := np.flatnonzero(left)):
        weights, round_ = base * np.exp(-rate * (1 - left / counts)), round_ + 1
        total += weights
        if round_ & (round_ - 1) == 0:
            duals += [w / best_configuration(lengths, w, counts, capacity)[0] for w in (weights, total)]
        for own in np.array_split(random.permutation(open_), math.ceil(len(open_) / block)):
            _, chosen = best_configuration(lengths[own], weights[own], np.maximum(1, left[own]), capacity)
            places, times = own[list(chosen)], np.array(list(chosen.values()), float)
            used = min((left[places] / times).min(), step * (counts[places] / times).min())
            left[places] -= used * times
            left[places[left[places] < 1e-6]] = 0
            uses[tuple(sorted(zip(places.tolist(), times.astype(int).tolist(), strict=True)))] += used
    dual = max(duals, key=lambda y: y @ counts)
    return Fraction(dict(uses), sum(uses.values()), dual, float(dual @ counts))


#: (rate, step) tried in turn until the solution is within TOLERANCE of its lower bound; the best plan of those tried counts.
SCHEDULE = ((1.0, 1.0), (0.3, 1.0), (1.0, 0.2), (8.0, 0.05))
TOLERANCE = 0.01


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over classes of equal sequences: (sequences, [(length, times)])."""
    by_room: dict[int, list] = defaultdict(list)
    mask = 0
    done = []
    for i in np.argsort(-lengths, kind="stable"):
        size, n = int(lengths[i]), int(left[i])
        while n:
            fits = mask >> size
            if not fits:
                per = capacity // size
                m, per = (n // per, per) if n >= per else (1, n)
                room, filled = capacity - per * size, [(size, per)]
                n -= m * per
            else:
                old = size + (fits & -fits).bit_length() - 1
                had, content = by_room[old].pop()
                m = min(had, n)
                if had > m:
                    by_room[old].append((had - m, content))
                if not by_room[old]:
                    mask &= ~(1 << old)
                room, filled = old - size, [*content, (size, 1)]
                n -= m
            if room:
                by_room[room].append((m, filled))
                mask |= 1 << room
            else:
                done.append((m, filled))
    return done + [x for group in by_room.values() for x in group]


class Packing(NamedTuple):
    """Where pieces go: arrays (length, first rank, times a sequence, first sequence, offset); how many sequences in
    all and from configurations of the LP; and the lower bound that the LP's dual proves."""

    rows: list[np.ndarray]
    sequences: int
    from_configurations: int
    bound: int


def rounded(fraction: Fraction, lengths: np.ndarray, left: np.ndarray, capacity: int, slack: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes of equal sequences: the configurations whose dual price is 1, or within slack of it, the most used first,
    each as often as its uses rounded up and the pieces left allow. Takes those pieces from `left`."""
    classes = []
    for config, uses in sorted(fraction.uses.items(), key=lambda c: (-c[1], c[0])):
        m = min([math.ceil(uses - 1e-9), *(int(left[i]) // k for i, k in config)])
        if m and sum(fraction.dual[i] * k for i, k in config) >= 1 - slack - 1e-9:
            classes.append((m, [(int(lengths[i]), k) for i, k in config]))
            for i, k in config:
                left[i] -= m * k
    return classes


def packed_classes(lengths: np.ndarray, counts: np.ndarray, capacity: int):
    """Classes of equal sequences from configurations, others by best-fit decreasing, and the lower bound."""
    best, bound = None, 0.0
    for rate, step in SCHEDULE:
        fraction = solve(lengths, counts, capacity, rate, step)
        found = rounded_in_depth(fraction, lengths, counts, capacity, rate, step)
        best = found if best is None or found[0] < best[0] else best
        bound = max(bound, fraction.bound)
        if fraction.sequences <= (1 + TOLERANCE) * fraction.bound:
            break
    return *best[1:], math.ceil(bound - 1e-6)


def rounded_in_depth(fraction: Fraction, lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float, step: float, least_gain: float = 0.2):
    """Number of sequences, classes from configurations, and others by best-fit decreasing.

    The solution is rounded, and the LP solved again for what is left, as long as that places least_gain of it. Of these
    depths that with the fewest sequences counts, and the deepest of those.
    """
    gap = fraction.sequences / fraction.bound - 1
    slack = 0 if gap <= TOLERANCE else gap
    left, classes, best = counts.copy(), [], None
    while True:
        own = np.flatnonzero(left)
        open_, before = left[own], (lengths * left).sum()
        classes = classes + rounded(fraction, lengths[own], open_, capacity, slack)
        left[own] = open_
        rest = best_fit(lengths, left, capacity)
        n = sum(m for m, _ in classes + rest)
        if best is None or n <= best[0]:
            best = n, classes, rest
        after = (lengths * left).sum()
        if after > (1 - least_gain) * before or not after:
            return best
        own = np.flatnonzero(left)
        fraction = solve(lengths[own], left[own], capacity, rate, step)


def packing_plan(histogram: dict[int, int], capacity: int = 4096) -> Packing:
    """The packing of pieces of these lengths, {length: number}."""
    full = histogram.get(capacity, 0)
    items = sorted((k, n) for k, n in histogram.items() if k < capacity and n)
    lengths, counts = (np.array([x[i] for x in items], np.int64) for i in (0, 1))
    configurations, rest, bound = packed_classes(lengths, counts, capacity) if items else ([], [], 0)
    if full:  # the configuration of one whole piece
        configurations = [*configurations, (full, [(capacity, 1)])]
    rank, sequence, rows = defaultdict(int), 0, []
    for m, content in configurations + rest:
        offset = 0
        for length, times in content:
            rows.append((length, rank[length], times, sequence, offset))
            rank[length] += m * times
            offset += length * times
        sequence += m
    rows.sort()
    arrays = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
    return Packing(arrays, sequence, sum(m for m, _ in configurations), bound + full)


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_bucket: int = 50_000) -> DataFrame:
    """pieces (doc_id, piece, length, ...; lengths from 1 to capacity) with sequence_id and offset, gapless from 0."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(packing_plan(counts, capacity).rows)
    buckets = max(16, math.ceil(sum(counts.values()) / rows_per_bucket))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")).select(
        "length", "__salt", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base")
    )
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__own", F.row_number().over(own)).join(base, ["length", "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__base") + F.col("__own") - 1).alias("__rank"))
    names = pieces.columns
    n, at = len(names), names.index("length")

    def run(batches):
        length, first, times, sequence, offset = shared.value
        keys = (length << 40) + first
        for batch in batches:
            size = np.asarray(batch.column(at)).astype(np.int64)
            rank = np.asarray(batch.column(n)).astype(np.int64)
            k = np.searchsorted(keys, (size << 40) + rank, side="right") - 1
            ahead = rank - first[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(sequence[k] + ahead // times[k]), pa.array(offset[k] + (ahead % times[k]) * size)],
                [*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    Of rows with one id each is a document of its own; a null id stays null. An empty table gives no rows.
    """
    return pack(cut(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): token ids of each sequence, from pieces that carry their ids. A sequence is bounded by the capacity."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
