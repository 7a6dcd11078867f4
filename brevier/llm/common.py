"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevier.functions.session import cut as cut
from brevier.functions.session import new_folder as new_folder
from brevier.functions.session import shared_dir as shared_dir
from brevier.functions.session import spread as spread

#: A word is a run of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Java's name for the same class, for Spark SQL expressions.
WORD_BREAK_JAVA = r"[\x20\x09-\x0D]+"


def held_out(id_col: str, buckets: int, held: int) -> Column:
    """True where crc32 of the id as text falls in the held-out bucket; rows without id are held out, too."""
    bucket = F.crc32(F.col(id_col).cast("string").cast("binary")) % buckets
    return F.coalesce(bucket == held, F.lit(True))


def kept_names(keep: tuple[str, ...], taken: tuple[str, ...]) -> list[str]:
    """Names under which kept columns come back: a name that a result has is prefixed with kept_."""
    return [f"kept_{c}" if c in taken else c for c in keep]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: pairs of long ids, any order, repeats and loops allowed. Returns (node, root), one row for each
    node that has an edge to another; root is the smallest node reachable. Each round takes minima with
    partial aggregation and joins them back, so that no neighbourhood is gathered in one place, and is
    cut by a checkpoint. The number of rounds grows with the logarithm of a component's size.
    """
    links = cut(
        edges.where(F.col(u) != F.col(v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(links)
    while before[0]:
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(parent, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        links = cut(small.union(parent.select("u", F.col("m").alias("v"))).distinct())
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
