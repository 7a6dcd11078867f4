"""Near copies by the Jaccard similarity of word shingles: ball hashing of short SimHashes, exact sets to verify.

Two texts are near copies if their sets of 5-word shingles have a Jaccard similarity J of 0.8 or more. Their
SimHashes then differ in a bit with probability arccos(2 J / (1 + J)) / pi, at 0.8 in 10 of 64 bits, out of any
ball's reach. So each text has several independent short SimHashes, and texts of which one pair differs in at most
two bits meet, as in `simhash`: every short fingerprint emits all variants within one bit, and the shuffle on table
and variant brings pairs together. Bits grow with the logarithm of the number of texts, so that a variant has
about one text at every size, and tables with the bits, so that pairs at the threshold are met with probability
RECALL (and nearer ones surely). Texts with one set of shingles are one node: exact copies cost nothing more.

At each of its variants a node is compared with the one before it, in the order of their numbers, so that these pairs are
linear in the nodes, however many near copies a group has. Pairs whose CHECK_BITS-bit SimHashes lie further apart than most
near copies' go no further here. Of the others, those whose parities part them surely (see `parity`) are dropped, and each
node's NEAREST nearest are left: the sets of these are read and decide. This is where links are sought first; what bears on
it alters the work that is left, not the result.

What ball hashing leaves apart is found exactly (`completed`). Sets of J >= t that are put in one order share a shingle
among their first n - ceil(t n) + 1, and the places of the first shared one bound what they can share (prefix and positional
filter), and parities bound what they can have apart. All pairs that meet so, fit, and are not yet in one group are compared
by their sets: no link is left out. The join at a shingle yields pairs that fit alone, so that a family of texts that are not
quite near enough brings it few rows. Any
order is right; this one puts last the shingles that unlike texts of a sample share, so that texts with a common frame don't
all meet at its shingles.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevier.llm.common import components, cut

LEAST_BITS, MOST_BITS, CHECK_BITS = 24, 48, 64
RECALL = 0.97
#: Bits of a parity and of the wide one that sets of more shingles than LONG have besides, powers of two.
PARITY_BITS, WIDE_BITS, LONG = 512, 8192, 512
#: How many others a node is compared with in the first pass.
NEAREST = 3
_random = np.random.default_rng(42)
#: Odd multipliers, one for each 64 bits of a text's SimHash.
FACTORS = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def bit_distance(similarity: float) -> float:
    """Share of SimHash bits in which sets of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(bits: int, threshold: float, recall: float = RECALL) -> int:
    """How many short SimHashes a pair at the threshold needs to have one that differs in two bits at most."""
    p = bit_distance(threshold)
    meets = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return 1 if meets > recall else math.ceil(math.log(1 - recall) / math.log(1 - meets))


def bits_for(n_nodes: int) -> int:
    """Bits at which a variant has one text on average, or fewer."""
    bits = LEAST_BITS
    while n_nodes * (bits + 1) > 1 << bits and bits < MOST_BITS:
        bits += 1
    return bits


def furthest(threshold: float) -> int:
    """Bits of CHECK_BITS that five of six pairs at the threshold stay within (one deviation), and nearly all nearer ones.

    At 0.8 these are 13 bits. Texts at 0.7, of which large families have many pairs, are mostly beyond.
    """
    p = bit_distance(threshold)
    return math.ceil(CHECK_BITS * p + math.sqrt(CHECK_BITS * p * (1 - p)))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; one shingle if the text has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(
        np.fromiter(
            (digest(joined[a : b - 1]) for a, b in zip(starts, starts[size:], strict=False)),
            np.uint64,
            len(words) - size + 1,
        )
    )


def simhash_words(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """So many words of 64 independent SimHash bits each of a set of shingle hashes."""
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words):
        votes = np.zeros(64, np.int64)
        for low in range(0, len(hashes), 65536):
            part = hashes[low : low + 65536] * FACTORS[k]
            part = (part ^ (part >> np.uint64(29))) * FACTORS[-1 - k]
            part ^= part >> np.uint64(32)
            votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]
    return out


def short_prints(words: np.ndarray, bits: int, tables: int) -> list[int]:
    """The first so many runs of so many bits."""
    line = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[: bits * tables].reshape(tables, bits)
    return (line.astype(np.int64) << np.arange(bits)).sum(1).tolist()


def parity(hashes: np.ndarray, n_bits: int = PARITY_BITS) -> np.ndarray:
    """So many bits, as words of 64: set where an odd number of a set's hashes falls.

    A shingle that two sets share falls on one bit in both, so their bits differ in no more places than there are shingles that
    only one of the sets has.
    """
    odd = np.bincount((hashes & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing(a: str, b: str) -> Column:
    """In how many bits the parities of two columns differ."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY_BITS // 64)), F.lit(0))


def differing_wide(a: str, b: str) -> Column:
    """The same of wide parities; 0 if one is null."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.coalesce(F.aggregate(bits, F.lit(0), lambda n, x: n + x), F.lit(0))


def can_reach(differing: Column, sizes: Column, threshold: float) -> Column:
    """False if two sets that have so many shingles together and so many, or more, of them apart are below the threshold."""
    return differing <= (1 - threshold) / (1 + threshold) * sizes + 1e-6


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, tables: int) -> DataFrame:
    """(id, key, set, size, parity, wide, check, prints) for each row: set names the set of shingles, by 128 bits."""
    n_words = math.ceil(bits * tables / 64)

    def run(batches):
        for batch in (whole.slice(low, 500) for whole in batches for low in range(0, whole.num_rows, 500)):
            sets, sizes, parities, wide, checks, prints = [], [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_set(text.as_py(), shingle)
                words = simhash_words(hashes, 1 + n_words)
                sets.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                parities.append(parity(hashes))
                wide.append(parity(hashes, WIDE_BITS) if len(hashes) > LONG else None)
                checks.append(words[0])
                prints.append(short_prints(words[1:], bits, tables))
            columns = [pa.array(sets, pa.binary()), pa.array(sizes, pa.int32())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (parities, wide)]
            columns += [pa.array(np.array(checks, np.uint64).view(np.int64)), pa.array(prints, pa.list_(pa.int64()))]
            names = ["id", "key", "set", "size", "parity", "wide", "check", "prints"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    key = "id long, key struct<a: bigint, b: bigint>"
    return rows.mapInArrow(run, f"{key}, set binary, size int, parity array<long>, wide array<long>, check long, prints array<long>")


def variants(nodes: DataFrame, bits: int) -> DataFrame:
    """(ball, node, check): each short fingerprint of each node and all within one bit of it, under the table's number."""
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(bits))]])
    return (
        nodes.select("node", "check", F.posexplode("prints").alias("table", "print"))
        .select("node", "check", "table", "print", F.explode(masks).alias("mask"))
        .select((F.col("print").bitwiseXOR(F.col("mask")) + F.col("table").cast("long") * (1 << bits)).alias("ball"), "node", "check")
    )


def met_pairs(rows: DataFrame, furthest: int) -> DataFrame:
    """(u, v, crowded) of nodes that meet at a variant (ball, node, check): each with the one before it, if its check bits are
    near. crowded: the variant has over four nodes, so that others may be near, too.

    The rows of a ball stand one after the other, in order of node; one pass looks four rows back and ahead, and holds a
    batch and twelve rows, whatever the size of a ball.
    """
    names = ["u", "v", "crowded"]

    def pairs(ball, node, check, low, high):
        """Pairs of rows from low to high with those before; the rows around must be there."""
        size, near = np.ones(len(ball), np.int8), np.zeros(len(ball), bool)
        for k in range(1, min(5, len(ball))):
            same = ball[k:] == ball[:-k]
            size[k:] += same
            size[:-k] += same
            if k == 1:
                near[1:] = same & (np.bitwise_count(check[1:] ^ check[:-1]) <= furthest)
        at = np.flatnonzero(near[low:high]) + low
        yield pa.RecordBatch.from_arrays([pa.array(node[at - 1]), pa.array(node[at]), pa.array(size[at] > 4)], names)

    def run(batches):
        held, done = None, 0
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            high = len(held[0]) - 4
            if high > done:
                yield from pairs(*held, done, high)
                keep = max(0, high - 8)
                held, done = [x[keep:] for x in held], high - keep
        if held:
            yield from pairs(*held, done, len(held[0]))

    dealt = rows.repartition("ball").sortWithinPartitions("ball", "node")
    return dealt.mapInArrow(run, "u long, v long, crowded boolean").groupBy("u", "v").agg(F.max("crowded").alias("crowded"))


def unparted(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, apart) of the pairs (u, v) whose parities leave it open that their sets reach the threshold; apart: the share in
    which they differ, at least. nodes: (node, size, parity, wide)."""
    a, b = (nodes.select(*[F.col(c).alias(f"{end}_{c}") for c in ("node", "size", "parity", "wide")]) for end in "uv")
    apart, sizes = F.greatest(differing("u_parity", "v_parity"), differing_wide("u_wide", "v_wide")), F.col("u_size") + F.col("v_size")
    both = pairs.join(a, F.col("u") == F.col("u_node")).join(b, F.col("v") == F.col("v_node"))
    return both.where(can_reach(apart, sizes, threshold)).select("u", "v", (apart / sizes).alias("apart"))


def nearest(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (u, v) that parities leave open, at each node those with the NEAREST others nearest to it."""
    met = cut(unparted(pairs, nodes, threshold))
    order = Window.partitionBy("node").orderBy("apart", "u", "v")
    ranked = met.withColumn("node", F.explode(F.array("u", "v"))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= NEAREST).select("u", "v").distinct()


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows of unlike id or text apart."""
    row = F.col(id_col).cast("long"), F.lit("text"), F.col(text_col)
    return F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit("key"), *row[::-1]).alias("b"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of (node, text)."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(low, 500) for low in range(0, batch.num_rows, 500)):
                sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


#: Keys of texts to verify or to drop that are broadcast; more are joined by a shuffle of the texts in question.
MOST_BROADCAST = 500_000
#: Halves of keys of rows to judge that are broadcast, which keeps the texts of all other rows out of a shuffle.
MOST_HALVES = 4_000_000


def halves(keyed: DataFrame, key: str = "key") -> DataFrame:
    """(__half) of the rows' keys, to be broadcast up to MOST_HALVES."""
    found = cut(keyed.select(F.col(f"{key}.a").alias("__half")).distinct())
    return F.broadcast(found) if found.count() <= MOST_HALVES else found


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, read from one of their rows."""
    keys = cut(nodes.join(wanted, "node").select("node", F.col("first.key").alias("key")))
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    if keys.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    else:
        rows = rows.withColumn("half", F.col("key.a")).join(halves(keys).withColumnRenamed("__half", "half"), "half", "left_semi")
    texts = rows.join(keys, "key").select("node", "text")
    return cut(shingle_sets(texts, shingle))  # a row repeated in docs repeats its node's


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v"
    )
    shared = F.size(F.array_intersect("a", "b"))
    near = shared >= threshold * (F.size("a") + F.size("b") - shared) - 1e-9
    return cut(both.where(near).select("u", "v").distinct())


#: Of so many texts one is read for the shingles that come last, and so many bits at most mark these.
SAMPLE, MOST_MARKS = 16, 28


def marks(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Bits by the leading bits of a shingle's hash, as words of 64: set for shingles that unlike sets of a sample share.

    Others that fall on a set bit are taken for such ones, too: the marks order shingles, and every order is right.
    """

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(low, 100) for low in range(0, whole.num_rows, 100)):
                sets = [shingle_set(text.as_py(), shingle) for text in batch.column(0)]
                names = np.array([xxhash.xxh32_intdigest(x.tobytes()) for x in sets], np.uint32).view(np.int32)
                own = np.repeat(names, [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(own)], ["token", "own"])

    sample = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    tokens = sample.mapInArrow(run, "token long, own int").groupBy("token").agg(F.min("own").alias("a"), F.max("own").alias("b"))
    shared = cut(tokens.where("a != b").select("token"))
    size = min(MOST_MARKS, max(10, (32 * shared.count()).bit_length()))
    at = shared.select(F.shiftrightunsigned("token", 64 - size).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def prefix(hashes: np.ndarray, threshold: float, marks: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, marked ones last: sets that reach the threshold share one of them."""
    at = hashes >> np.uint64(64 - 6 - (len(marks).bit_length() - 1))
    late = (marks[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    length = len(hashes) - math.ceil(threshold * len(hashes) - 1e-6) + 1 if len(hashes) else 0
    return np.concatenate([hashes[~late], hashes[late]])[:length]


def prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, marks: np.ndarray) -> DataFrame:
    """(key, size, tokens) for each row: how many shingles its set has, and the first of them."""

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(low, 500) for low in range(0, whole.num_rows, 500)):
                sets = [shingle_set(text.as_py(), shingle) for text in batch.column(1)]
                tokens = [prefix(x, threshold, marks).view(np.int64) for x in sets]
                columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(tokens, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "tokens"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "key struct<a: bigint, b: bigint>, size int, tokens array<long>")


def postings(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, node, size, rest) of first shingles that two nodes or more have; rest: how many of the node's, from this one on."""
    keys = nodes.select("node", F.col("first.key").alias("key"))
    keys = F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys
    rows = prefixes.join(keys, "key").select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    token = Window.partitionBy("token")
    both = rows.select("token", "node", "size", (F.col("size") - F.col("pos")).alias("rest"))
    return both.withColumns({"a": F.min("node").over(token), "b": F.max("node").over(token)}).where("a != b").drop("a", "b")


def fitting(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of pairs (node, root, size, rest, maybe parity, and the same with other_) of unlike roots whose sets can reach the
    threshold, if the token at which they meet is their first."""
    sizes = F.col("size") + F.col("other_size")
    need = threshold / (1 + threshold) * sizes - 1e-6
    fit = pairs.where((F.col("root") != F.col("other_root")) & (F.least("rest", "other_rest") >= need))
    if "parity" in pairs.columns:
        fit = fit.where(can_reach(differing("parity", "other_parity"), sizes, threshold))
    return fit.select(F.least("node", "other_node").alias("u"), F.greatest("node", "other_node").alias("v")).distinct()


#: Nodes of other roots that a node meets at a token, on average, up to which all are compared at once.
FEW = 1000


def completed(links: DataFrame, postings: DataFrame, sets_of, threshold: float, nodes: DataFrame | None = None) -> DataFrame:
    """links, and all others between nodes that they leave apart. sets_of: gives (node, hashes) of wanted nodes. nodes: (node,
    size, parity, wide) of all; without them more pairs are compared by their sets.

    Pairs of unlike roots are all compared once they are few, or once a round brings no link. Before, a round compares at
    each token one node of a root with one of the next, so that large groups join without all their pairs.
    """
    names = ["node", "root", "size", "rest"] + ["parity"] * (nodes is not None)

    def found(met: DataFrame) -> DataFrame:
        pairs = fitting(met, threshold)
        return joined(cut(pairs if nodes is None else unparted(pairs, nodes, threshold).select("u", "v")), sets_of, threshold)

    while True:
        roots = components(links)
        rooted = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        counts = rooted.groupBy("token", "root").agg(F.count("*").alias("n"))
        each = counts.groupBy("token").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        apart = rooted.join(each.where("roots > 1"), "token")
        apart = cut(apart if nodes is None else apart.join(nodes.select("node", "parity"), "node"))
        rows, all_pairs = apart.agg(F.count("*"), F.sum((F.col("n") * F.col("n") - F.col("own")) / F.col("n"))).first()
        if not rows:
            return links
        if all_pairs <= FEW * rows:
            break
        order = Window.partitionBy("token").orderBy("root", "node")
        met = apart.withColumns({f"other_{c}": F.lag(c).over(order) for c in names})
        new = found(met)
        if new.isEmpty():
            break
        links = cut(links.union(new))
    other = apart.select("token", *[F.col(c).alias(f"other_{c}") for c in names])
    met = apart.where("root != most").join(other, "token")
    return cut(links.union(found(met)))


def joined(pairs: DataFrame, sets_of, threshold: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets, read for these pairs, reach the threshold."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return verified(pairs, sets_of(ends), threshold)


def near_copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(id, key, group) for each row: group names the rows joined by chains of near copies.

    Null and wordless texts have the empty set, and are copies of each other.
    """
    bits = bits_for(docs.count())
    prints = cut(sketches(docs, id_col, text_col, shingle, bits, tables_for(bits, threshold)))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first")
    each = prints.groupBy("set").agg(first, *[F.any_value(c).alias(c) for c in ("size", "parity", "wide", "check", "prints")])
    nodes = cut(each.withColumn("node", F.monotonically_increasing_id()))
    sets = lambda wanted: sets_of(wanted, nodes, docs, id_col, text_col, shingle)
    met = met_pairs(variants(nodes, bits), furthest(threshold)).select("u", "v")
    links = joined(cut(nearest(met, nodes, threshold)), sets, threshold)
    first = prefixes(docs, id_col, text_col, shingle, threshold, marks(docs, text_col, shingle))
    links = completed(links, cut(postings(first, nodes)), sets, threshold, nodes)
    named = nodes.select("set", "node").join(components(links), "node", "left").select("set", F.coalesce("root", "node").alias("group"))
    return prints.select("id", "key", "set").join(named, "set").select("id", "key", "group")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group, the first by id (null last) and row key; all columns are kept.

    A row key is a hash of id and text. Rows of one id with unlike texts are judged apart; of repeated rows, which
    share a key, one stays.
    """
    groups = cut(near_copy_groups(docs, id_col, text_col, **how))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    firsts = groups.groupBy("group").agg(F.min(order)["key"].alias("first"), F.count("*").alias("n")).where("n > 1")
    judged = cut(
        groups.join(firsts, "group")
        .groupBy("key", "first")
        .agg(F.count("*").alias("n"))
        .where("key != first or n > 1")
        .select(F.col("key").alias("__key"), (F.col("key") == F.col("first")).alias("stays"))
    )
    half = halves(judged, "__key")
    judged = F.broadcast(judged) if judged.count() <= MOST_BROADCAST else judged
    keyed = docs.withColumn("__key", row_key(id_col, text_col)).withColumn("__half", F.col("__key.a"))
    met = keyed.join(half, "__half", "left_semi")
    single = keyed.join(half, "__half", "left_anti").unionByName(met.join(judged, "__key", "left_anti"))
    repeated = met.join(judged.where("stays"), "__key", "left_semi").dropDuplicates(["__key"])
    return single.unionByName(repeated).select(*docs.columns)
