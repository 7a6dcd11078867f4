"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, and a proof that each row belongs to the root.

A leaf is the SHA-256 of a row's fields. The leaves of a group (say, a language) stand in the order of their ids; every
`fanout` consecutive nodes (the last run may have fewer, even one) become the digest of their hex digests, joined, while
more than one is left. What remains is the group's subroot; the subroots, ordered by group, become the root in the same way.

Leaves get their places by a range sort, so that a group of any size is spread over all tasks. A tree is then cut into
aligned blocks, of fanout ** height leaves: a block's digests are one contiguous NumPy matrix of 64 hex letters a row, whose
reshaping by the fanout puts each run in a row, level by level. The blocks' tops are the leaves of the next tier, so that
no task sees more than a block of any tree. Proofs are made on the way down: index arithmetic on each level's matrix
picks the siblings in the block, and those of the block's top in the tier above follow.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from brevier.llm.common import cut, kept_names

#: Hex letters of a digest.
WIDTH = 64
OWN = ("id", "group", "leaf", "position", "size", "group_position", "n_groups", "subroot", "root", "proof")


def encoded(value: Column) -> Column:
    """A field as `-` if null, else the number of its UTF-8 bytes, a colon and the value; unambiguous when joined."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The lower-case hex SHA-256 of a row's fields, in this order."""
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def hashed_rows(rows: np.ndarray) -> np.ndarray:
    """The hex digest of each row of bytes, as rows of 64 bytes."""
    data, width = memoryview(rows.tobytes()), rows.shape[1]
    digests = [sha256(data[k : k + width]).hexdigest() for k in range(0, len(data), width)]
    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, WIDTH)


def levels(leaves: np.ndarray, fanout: int, height: int | None = None) -> list[np.ndarray]:
    """Digest matrices from the leaves up to a single node, or up by so many levels."""
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        below = out[-1]
        full = len(below) // fanout * fanout
        above = hashed_rows(below[:full].reshape(-1, fanout * WIDTH))
        if full < len(below):
            above = np.concatenate([above, hashed_rows(below[full:].reshape(1, -1))])
        out.append(above)
    return out


def proofs(tree: list[np.ndarray], fanout: int, upper: bytes) -> pa.Array:
    """For each leaf the digests of its siblings, level by level, left to right, then `upper`; joined."""
    n = len(tree[0])
    parts, there = [], []
    for height, level in enumerate(tree[:-1]):
        own = np.arange(n) // fanout**height
        slots = (own // fanout * fanout)[:, None] + np.arange(fanout)
        others = slots[slots != own[:, None]].reshape(n, fanout - 1)
        there.append(others < len(level))
        parts.append(level[np.minimum(others, len(level) - 1)])
    above = np.frombuffer(upper, np.uint8).reshape(1, -1, WIDTH)
    parts.append(np.broadcast_to(above, (n, above.shape[1], WIDTH)))
    there.append(np.ones((n, above.shape[1]), bool))
    held = np.concatenate(there, axis=1)
    data = np.concatenate(parts, axis=1)[held]
    ends = np.concatenate([[0], np.cumsum(held.sum(1))]) * WIDTH
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes()))


def folded(leaf: str, proof: str, trees: list[tuple[int, int]], fanout: int = 2) -> str:
    """The root that a leaf and its siblings lead to; trees: place of the node and number of nodes, from the leaf's tree up."""
    own, at = leaf, 0
    for place, size in trees:
        while size > 1:
            start = place // fanout * fanout
            left = at + (place - start) * WIDTH
            end = at + (min(fanout, size - start) - 1) * WIDTH
            own = sha256((proof[at:left] + own + proof[left:end]).encode()).hexdigest()
            at, place, size = end, place // fanout, -(-size // fanout)
    return own


def matrix(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """A block's digests in the order of their positions, and its rows in that order."""
    table = table.take(pa.array(np.argsort(table["position"].to_numpy())))
    return np.array(table["digest"].to_pylist(), f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH), table


def block_tree(table: pa.Table, fanout: int, height: int) -> tuple[list[np.ndarray], pa.Table]:
    """The levels of a block: up to the top of a tree that is one block, else by the height of all blocks."""
    leaves, table = matrix(table)
    return levels(leaves, fanout, height if table["size"][0].as_py() > fanout**height else None), table


def in_blocks(nodes: DataFrame, leaves: int) -> DataFrame:
    return nodes.withColumn("__block", F.floor(F.col("position") / leaves).cast("long"))


def numbered(nodes: DataFrame, order: list[str], per_range: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """nodes (branch, ...) with position, from 0, among the rows of their branch in a total order, and their number, size.

    A task sorts about per_range rows, more as soon as all cores have as many, and no more than `most`.
    """
    n, cores = nodes.count(), nodes.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-n // most), min(cores, -(-n // per_range)))
    by = ["branch", *order]
    dealt = cut(nodes.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__range", F.shiftright("__at", 33))
    own = Window.partitionBy("branch")
    before = own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("branch", "__range")
        .agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
        .select(
            "branch",
            "__range",
            (F.col("__first") - F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__base"),
            F.sum("__n").over(own).alias("size"),
        )
    )
    joined = dealt.join(starts, ["branch", "__range"]).withColumn("position", F.col("__at") - F.col("__base"))
    return joined.drop("__at", "__base", "__range")


def tops(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """(branch, position, size, digest) of the blocks' top nodes: the next tier."""
    whole = fanout**height

    def run(table: pa.Table) -> pa.Table:
        tree, rows = block_tree(table, fanout, height)
        size = rows["size"][0].as_py()
        return pa.table(
            {
                "branch": rows["branch"].slice(0, 1),
                "position": pa.array([rows["position"][0].as_py() // whole], pa.int64()),
                "size": pa.array([-(-size // whole)], pa.int64()),
                "digest": [tree[-1].tobytes().decode()],
            }
        )

    cells = in_blocks(nodes.select("branch", "position", "size", "digest"), whole)
    return cells.groupBy("branch", "__block").applyInArrow(run, "branch string, position long, size long, digest string")


def climb(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """The tiers of all branches' trees, from the nodes to one top for each branch."""
    tiers = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 1
    while most > 1 or len(tiers) == 1:
        tiers.append(cut(tops(tiers[-1], fanout, height)))
        most = -(-most // fanout**height)
    return tiers


def descend(tiers: list[DataFrame], upper: DataFrame, fanout: int, height: int) -> DataFrame:
    """The nodes of the lowest tier with path and what else `upper` (branch, path, ...) has for their branch's top.

    A path has the digests of the siblings from the node up: those of its own tree, then the path of upper.
    """
    carried = [c for c in upper.columns if c not in ("branch", "path")]
    above = upper.withColumn("position", F.lit(0).cast("long"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, rows = block_tree(left.drop_columns(["__block"]), fanout, height)
        rows = rows.append_column("path", proofs(tree, fanout, right["path"][0].as_py().encode()))
        for c in carried:
            rows = rows.append_column(c, pa.repeat(right[c][0], len(rows)))
        return rows

    for tier in reversed(tiers[:-1]):
        schema = StructType([*tier.schema.fields, *upper.select("path", *carried).schema.fields])
        high = above.select("branch", F.col("position").alias("__block"), "path", *carried)
        keys = ["branch", "__block"]
        above = in_blocks(tier, fanout**height).groupBy(*keys).cogroup(high.groupBy(*keys)).applyInArrow(run, schema)
    return above


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    fanout: int = 2,
    keep: tuple[str, ...] = (),
    most_leaves: int = 1024,
) -> DataFrame:
    """One row for each row of docs: id, group, leaf, position, size, group_position, n_groups, subroot, root, proof, and keep.

    position and size tell the leaf's place and number in its group, group_position and n_groups the same of the group's
    subroot; with proof, the siblings' digests joined in the order in which they are needed, they lead to root (`fold`).
    Groups are ordered by their UTF-8 bytes, null first and apart from the empty text; leaves by id, null first, rows of
    one id by their leaf. Repeated rows are leaves of their own. An empty table has no rows, and so no root. Any type that
    casts to a text can be a field. A block has the largest power of the fanout that most_leaves allows. A kept name that the result has already comes back as kept_<name>.
    """
    if not 2 <= fanout <= 256:
        raise ValueError("fanout must be from 2 to 256")
    shape = fanout, max(1, int(math.log(most_leaves, fanout) + 1e-9))
    names = [f"__keep{k}" for k in range(len(keep))]
    leaves = cut(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("branch"),
            F.col(id_col).alias("id"),
            leaf_digest(*map(F.col, fields)).alias("digest"),
            F.monotonically_increasing_id().alias("__row"),  # equal rows stand in some order, and may lie in two ranges
            *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
        )
    )
    tiers = climb(cut(numbered(leaves, ["id", "digest", "__row"]).drop("__row")), *shape)
    subroots = tiers[-1].select(F.lit("").alias("branch"), F.col("branch").alias("own"), "digest")
    groups = climb(cut(numbered(subroots, ["own"])), *shape)
    roots = groups[-1].select("branch", F.lit("").alias("path"), F.col("digest").alias("root"))
    upper = cut(descend(groups, roots, *shape)).select(
        F.col("own").alias("branch"),
        "path",
        F.col("position").alias("group_position"),
        F.col("size").alias("n_groups"),
        F.col("digest").alias("subroot"),
        "root",
    )
    return descend(tiers, upper, *shape).select(
        "id",
        F.when(F.col("branch") != "", F.expr("substring(branch, 2)")).alias("group"),
        F.col("digest").alias("leaf"),
        *OWN[3:-1],
        F.col("path").alias("proof"),
        *[F.col(n).alias(c) for n, c in zip(names, kept_names(keep, OWN), strict=True)],
    )


def fold(rows: DataFrame, leaf: str = "leaf", name: str = "folded_root", fanout: int = 2) -> DataFrame:
    """rows of a manifest with the root that the leaf in this column and the row's proof lead to; null for a null leaf."""
    fields = [leaf, "proof", "position", "size", "group_position", "n_groups"]

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in fields]
            roots = [
                None if own is None else folded(own, proof, [(at, size), (group, groups)], fanout)
                for own, proof, at, size, group, groups in zip(*columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))
