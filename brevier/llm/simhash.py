"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a point that differs from each in at most r bits. Each
distinct fingerprint therefore emits every variant within r bits; fingerprints that meet in a variant are
candidates, and a chain through each meeting place, verified by its Hamming distance, links them all. The
work grows with the number of distinct fingerprints; copies share one and cost nothing more. A meeting place
holds at most as many fingerprints as a ball of radius r has points (65 for r = 1).
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevier.llm.common import components, cut

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[size:], strict=False)),
        np.uint64,
        len(words) - size + 1,
    )
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """(id, fp long) for each row; a null or wordless text has fingerprint 0."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "fp"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long"
    )


def ball_links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Verified links (u, v) among distinct fingerprints that connect all within max_bits (even) of each other."""
    if max_bits % 2 or max_bits < 0:
        raise ValueError("max_bits must be even: the ball's radius is half of it")
    masks = [
        sum(1 << b for b in bits) for r in range(max_bits // 2 + 1) for bits in combinations(range(BITS), r)
    ]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    variants = nodes.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    meet = Window.partitionBy("variant").orderBy("fp")
    return (
        variants.withColumn("u", F.lag("fp").over(meet))
        .where("u is not null")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("u"))) <= max_bits)
        .select("u", F.col("fp").alias("v"))
        .distinct()
    )


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    seed: int = 42,
    max_bits: int = 2,
) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most max_bits bits.

    One row for each input row, repeated rows included. Null and empty texts share fingerprint 0 and link
    like any other. A null id keeps its row and never becomes a component's name unless all its ids are null.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(ball_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(names, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents whose group has a smaller id; all columns are kept.

    Of several rows with one id all stay or go together; rows with a null id stay.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **how)
    gone = groups.where("id > component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
