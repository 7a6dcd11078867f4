"""Benchmark decontamination by greedy string tiling.

Seeds: a run of min_match tokens (of all its tokens for a shorter item) that a document shares with a test item.
A tile of n tokens holds n - min_match + 1 seeds, so that a document must share at least need = coverage * size /
min_match of an item's seed places to be compared with it. Tiling: running Karp-Rabin looks for the longest common
runs of unmarked tokens, marks them longest first, and repeats with shorter ones down to min_match, so that a
passage is found whatever the order of its parts. A document is contaminated where the tiles cover at least
`coverage` of an item's tokens. Tokens and seeds are told apart by 64-bit hashes.

While the benchmark has at most max_broadcast_tokens tokens it is broadcast, as sorted arrays, and the documents
are scanned without a shuffle. Beyond that seeds and candidate pairs are joined by shuffles; there each item leaves
out its most frequent seeds as long as these have fewer places than it needs, so that common phrases make no pairs.
Both ways give the same rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevier.llm.common import cut

TOKEN = re.compile(r"\w+")
BASE, MODULUS = 1_000_003, (1 << 61) - 1
CACHE, VOCABULARY, SIEVE = 300_000, 100_000, 1 << 20
KEY, KEY_SQL = pa.struct([("a", pa.int64()), ("b", pa.int64())]), "struct<a: bigint, b: bigint>"
PAIRS = "doc_id long, item_id long, n_tiles int, matched_tokens int, item_tokens int, coverage double"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def free_runs(marked: np.ndarray, size: int):
    """(start, end) of each run of at least so many unmarked places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[1], marked.astype(np.int8), [1]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= size:
            yield int(a), int(b)


def rolled(seq: list[int], marked: np.ndarray, size: int):
    """(place, hash) of each unmarked run of `size` tokens, by Karp and Rabin's rolling hash."""
    top = pow(BASE, size - 1, MODULUS)
    for a, b in free_runs(marked, size):
        value = 0
        for x in seq[a : a + size]:
            value = (value * BASE + x) % MODULUS
        yield a, value
        for k in range(a + 1, b - size + 1):
            value = ((value - seq[k - 1] * top) * BASE + seq[k + size - 1]) % MODULUS
            yield k, value


def tiles(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (item place, doc place, length), the longest marked first."""
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found, size = [], len(item)
    while size >= min_match:
        table = defaultdict(list)
        for place, value in rolled(item, in_item, size):
            table[value].append(place)
        runs = []
        if table:
            for q, value in rolled(doc, in_doc, size):
                for p in table.get(value, ()):
                    if p and q and not in_item[p - 1] and not in_doc[q - 1] and item[p - 1] == doc[q - 1]:
                        continue  # the run that starts further left has it
                    n = 0
                    while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and not in_item[p + n] and not in_doc[q + n]:
                        n += 1
                    if n == len(item):
                        return [(0, q, n)]
                    if n >= size:
                        runs.append((n, p, q))
        before = len(found)
        for n, p, q in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
            if in_item[p : p + n].any() or in_doc[q : q + n].any():
                break  # what is left of this run may be longer than the next one: look again
            in_item[p : p + n] = True
            in_doc[q : q + n] = True
            found.append((p, q, n))
        if len(found) == before:
            if size == min_match:
                break
            size = max(min_match, size // 2)
    return found


def tile_pair(item: list, doc: list, min_match: int) -> tuple[int, int]:
    """Number of tiles and of tokens in them."""
    number = {w: k + 1 for k, w in enumerate(dict.fromkeys(item))}
    found = tiles([number[w] for w in item], [number.get(w, -k - 1) for k, w in enumerate(doc)], min_match) if item else []
    return len(found), sum(t[2] for t in found)


class TokenHashes(dict):
    """64-bit hashes of tokens, kept for the next text; forgotten between texts once there are more than `limit`."""

    def __init__(self, limit: float = CACHE):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        words = tokens(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seeds_of(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many tokens, at the place where it starts."""
    out = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


def least_places(n_tokens: int, size: int, coverage: float) -> int:
    """How many of an item's seed places tiles of at least `size` tokens hold that cover enough of it."""
    return max(1, math.ceil(coverage * n_tokens / size - 1e-9))


class Items:
    """A benchmark as arrays: tokens of all items, and for each seed length the sorted seeds with their items."""

    def __init__(self, rows: list[tuple[int | None, str]], min_match: int, coverage: float):
        self.min_match, self.coverage = min_match, coverage
        hashes = TokenHashes(limit=math.inf)  # the benchmark's whole vocabulary: its tokens are bounded by the caller
        listed = [(k, h) for k, h in ((k, hashes.of(t)) for k, t in rows) if len(h)]
        #: Tokens of a small benchmark: others need no hash of their own.
        self.vocabulary = dict(hashes) if len(hashes) <= VOCABULARY else None
        self.ids = [k for k, _ in listed]
        self.tokens = [h for _, h in listed]
        self.sizes = np.array([min(min_match, len(h)) for h in self.tokens], np.int64)
        self.need = np.array([least_places(len(h), s, coverage) for h, s in zip(self.tokens, self.sizes, strict=True)], np.int64)
        self.tables = []
        for size in np.unique(self.sizes).tolist():
            own = [k for k in range(len(listed)) if self.sizes[k] == size]
            seeds = np.concatenate([seeds_of(self.tokens[k], size) for k in own])
            item = np.repeat(own, [len(self.tokens[k]) - size + 1 for k in own])
            order = np.lexsort((item, seeds))
            distinct, starts = np.unique(seeds[order], return_index=True)
            seen = np.zeros(SIEVE, bool)
            seen[distinct & np.uint64(SIEVE - 1)] = True
            self.tables.append((size, distinct, np.append(starts, len(order)), item[order], seen))

    def hashed(self, text: str | None, hashes: TokenHashes) -> np.ndarray:
        """Token hashes of a text; 0 for tokens that no item has, where the vocabulary is at hand."""
        if self.vocabulary is None:
            return hashes.of(text)
        words = tokens(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))

    def found(self, hashed: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, tiles, tokens in them) of each item that a text of these token hashes holds."""
        out = []
        for size, distinct, starts, item, seen in self.tables:
            seeds = seeds_of(hashed, size)
            places = np.flatnonzero(seen[seeds & np.uint64(SIEVE - 1)])
            at = np.minimum(np.searchsorted(distinct, seeds[places]), len(distinct) - 1)
            hit = distinct[at] == seeds[places]
            places, shared = places[hit], np.unique(at[hit])
            if not len(shared):
                continue
            held, n = np.unique(np.concatenate([item[starts[k] : starts[k + 1]] for k in shared.tolist()]), return_counts=True)
            likely = held[n >= self.need[held]]
            if len(likely):
                doc = covered_tokens(hashed, places, size)
                for k in likely.tolist():
                    n_tiles, matched = tile_pair(self.tokens[k].tolist(), doc, size)
                    if matched >= self.coverage * len(self.tokens[k]):
                        out.append((k, n_tiles, matched))
        return sorted(out)


def covered_tokens(hashed: np.ndarray, places: np.ndarray, size: int) -> list:
    """The tokens that seeds at these places cover, with a gap where others lie between: no tile holds any of those."""
    out, end = [], 0
    for p in places.tolist():
        if p > end:
            out.append(None)
        out += hashed[max(p, end) : p + size].tolist()
        end = p + size
    return out


def pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    names = ["doc_id", "item_id", "n_tiles", "matched_tokens", "item_tokens", "coverage"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def by_scan(docs: DataFrame, items: Items) -> DataFrame:
    """Contaminated pairs of docs (id, text), with the whole benchmark at hand in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        known, hashes = shared.value, TokenHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, n, matched in known.found(known.hashed(text.as_py(), hashes)):
                    size = len(known.tokens[k])
                    out.append((doc_id, known.ids[k], n, matched, size, matched / size))
            yield pairs_batch(out)

    return docs.select("id", "text").mapInArrow(run, PAIRS)


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows (id, text) with a key of 128 bits: rows that share it are repeated rows. Null ids and texts have keys, too."""
    return rows.withColumn(key, F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit("key"), "text", "id").alias("b")))


def by_join(docs: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """Contaminated pairs of docs and items (id, text, key) by shuffles, with the document's key: seeds first, then the texts
    of candidate pairs."""

    def item_seeds(batches):
        hashes = TokenHashes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashed = hashes.of(text)
                if len(hashed):
                    size = min(min_match, len(hashed))
                    seeds, n = np.unique(seeds_of(hashed, size), return_counts=True)
                    need = least_places(len(hashed), size, coverage)
                    rows += [(key, size, int(s), int(k), need) for s, k in zip(seeds.view(np.int64), n, strict=True)]
            kinds = [KEY, pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["item_key", "size", "seed", "places", "need"])

    right = cut(items.select("item_key", "text").mapInArrow(item_seeds, f"item_key {KEY_SQL}, size int, seed long, places int, need int").distinct())
    wanted = [r["size"] for r in right.select("size").distinct().collect()]

    def doc_seeds(batches):
        hashes = TokenHashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                hashed = [hashes.of(t.as_py()) for t in part.column(1)]
                for size in wanted:
                    found = [np.unique(seeds_of(h, size)) for h in hashed]
                    at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(np.full(len(at), size, np.int32)), pa.array(np.concatenate(found).view(np.int64))],
                        ["key", "size", "seed"],
                    )

    on = ["size", "seed"]
    left = cut(
        docs.select("key", "text").mapInArrow(doc_seeds, f"key {KEY_SQL}, size int, seed long").join(right.select(on).distinct(), on, "left_semi")
    )
    frequency = left.groupBy(on).agg(F.count("*").alias("n_docs"))
    # The most frequent seeds of an item are left out while the places left out are fewer than it needs.
    before = Window.partitionBy("item_key").orderBy(F.desc("n_docs"), "seed")
    chosen = right.join(frequency, on).withColumn("passed", F.sum("places").over(before)).where("passed >= need")
    pairs = left.join(chosen.select(*on, "item_key"), on).select("key", "item_key").distinct()

    def judge(batches):
        hashes = TokenHashes()
        for batch in batches:
            out, keys = [], []
            for key, doc_id, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = Items([(item_id, item)], min_match, coverage)
                for _, n, matched in one.found(hashes.of(text)):
                    size = len(one.tokens[0])
                    out.append((doc_id, item_id, n, matched, size, matched / size))
                    keys.append(key)
            rows = pairs_batch(out)
            yield pa.RecordBatch.from_arrays([pa.array(keys, KEY), *rows.columns], ["key", *rows.schema.names])

    return (
        pairs.join(docs, "key")
        .join(items.select("item_key", F.col("id").alias("item_id"), F.col("text").alias("item")), "item_key")
        .select("key", "id", "text", "item_id", "item")
        .mapInArrow(judge, f"key {KEY_SQL}, {PAIRS}")
    )


def read_benchmark(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, coverage: float, max_broadcast_tokens: int):
    """The items (id, text), and all of them as arrays if they have no more tokens than may be broadcast."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")))).first()[0]
    small = (size or 0) <= max_broadcast_tokens
    return items, Items([(r["id"], r["text"]) for r in items.collect()], min_match, coverage) if small else None


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    coverage: float = 0.6,
    max_broadcast_tokens: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_tiles, matched_tokens, item_tokens, coverage) for each contaminated pair.

    Tokens are lower-cased runs of letters, digits and underscores. Null and empty texts, and items without a token,
    match nothing. An item of fewer than min_match tokens is one tile: it matches where it stands whole. Repeated rows, of
    documents or items, give repeated pairs. Rows with a null id are judged like others and named null.
    """
    items, small = read_benchmark(benchmark, item_id_col, item_text_col, min_match, coverage, max_broadcast_tokens)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if small is not None:
        return by_scan(rows, small)
    return by_join(keyed(rows, "key"), keyed(items, "item_key"), min_match, coverage).drop("key")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    coverage: float = 0.6,
    max_broadcast_tokens: int = 2_000_000,
) -> DataFrame:
    """docs without contaminated rows, each judged by its own text; all columns are kept."""
    items, small = read_benchmark(benchmark, item_id_col, item_text_col, min_match, coverage, max_broadcast_tokens)
    if small is None:
        rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "key")
        bad = by_join(rows, keyed(items, "item_key"), min_match, coverage).select("key").distinct()
        own = F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit("key"), text_col, id_col).alias("b"))
        return docs.withColumn("__key", own).join(bad.withColumnRenamed("key", "__key"), "__key", "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(small)
    at = docs.columns.index(text_col)

    def run(batches):
        known, hashes = shared.value, TokenHashes()
        for batch in batches:
            yield batch.filter(pa.array([not known.found(known.hashed(t.as_py(), hashes)) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
