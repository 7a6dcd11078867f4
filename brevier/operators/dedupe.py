"""Order-sensitive removal of duplicates on either of two keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevier.functions.session import cut, new_folder


def not_in_inventory(new: DataFrame, inventory: DataFrame, keys: tuple[str, str] = ("url_key", "title_key")) -> DataFrame:
    """Rows of new that share neither key with a row of inventory; inventory's empty or null keys count for nothing."""
    out = new
    for key in keys:
        known = inventory.select(F.col(key).alias("__known")).where(F.col("__known") != "").distinct()
        out = out.join(known, out[key] == F.col("__known"), "left_anti")
    return out


def greedy_distinct(
    rows: DataFrame, order: str = "seq", keys: tuple[str, str] = ("url_key", "title_key"), eligible: str | None = None
) -> DataFrame:
    """(order, accepted): what taking rows one after the other would accept, found in parallel rounds.

    A row is accepted if it is eligible (a boolean column; all are without it) and no accepted row before it
    has its first or its second key. Each round accepts the rows that come first among the undecided ones of
    both their keys, and rejects those that share a key with an accepted one; this gives the same rows as the
    sequential pass (greedy maximal independent set). Firsts are found by partial aggregation, so that a key
    that many rows share gathers nowhere. Two rows in a chain of conflicts are decided some rounds apart; the
    number of rounds is logarithmic for random orders. order must be unique; null keys conflict with nothing.
    """
    a, b = keys
    wanted = rows if eligible is None else rows.where(F.coalesce(F.col(eligible), F.lit(False)))
    open_ = cut(wanted.select(F.col(order).alias("seq"), F.col(a).alias("a"), F.col(b).alias("b")))
    spark, folder, rounds = rows.sparkSession, new_folder(rows.sparkSession, "accepted"), 0
    while not open_.isEmpty():
        first_a = open_.where("a is not null").groupBy("a").agg(F.min("seq").alias("first_a"))
        first_b = open_.where("b is not null").groupBy("b").agg(F.min("seq").alias("first_b"))
        (
            open_.join(first_a, "a", "left")
            .join(first_b, "b", "left")
            .where((F.coalesce("first_a", "seq") == F.col("seq")) & (F.coalesce("first_b", "seq") == F.col("seq")))
            .select("seq", "a", "b")
            .write.parquet(f"{folder}/round={rounds}")
        )
        taken = spark.read.schema(open_.schema).parquet(f"{folder}/round={rounds}")
        rounds += 1
        rest = open_.join(taken.select("seq"), "seq", "left_anti")
        for key in ("a", "b"):
            gone = taken.select(F.col(key).alias("__gone")).where("__gone is not null").distinct()
            rest = rest.join(gone, rest[key] == F.col("__gone"), "left_anti")
        open_ = cut(rest)
    # The rounds' rows lie in one folder: reading them is one scan, however many rounds there were.
    chosen = spark.read.schema(open_.schema).parquet(f"{folder}/*") if rounds else open_
    chosen = chosen.select("seq")
    return rows.select(F.col(order).alias("seq")).join(
        chosen.withColumn("accepted", F.lit(True)), "seq", "left"
    ).select(F.col("seq").alias(order), F.coalesce("accepted", F.lit(False)).alias("accepted"))


def outcomes(
    rows: DataFrame,
    inventory: DataFrame,
    reason: str = "reason",
    order: str = "seq",
    keys: tuple[str, str] = ("url_key", "title_key"),
    judge: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """rows with outcome: dup_existing, dup_within, the content reason, or accepted.

    Duplicates are looked for before contents are judged, and only accepted rows block later ones. judge: gives rows their
    reason, and more columns; it sees only rows that the inventory lacks, and the others' columns stay null.
    """
    if judge:
        rows = cut(rows)
    fresh = not_in_inventory(rows, inventory, keys).select(F.col(order).alias("__fresh")).distinct()
    marked = rows.join(fresh, rows[order] == F.col("__fresh"), "left")
    marked = cut(marked.withColumn("__new", F.col("__fresh").isNotNull()).drop("__fresh"))
    if judge:
        seen = judge(marked.where("__new").drop("__new"))
        columns = seen.columns
        known = marked.where("not __new").select(*[c for c in columns if c in marked.columns])
        marked = cut(seen.withColumn("__new", F.lit(True)).unionByName(known.withColumn("__new", F.lit(False)), allowMissingColumns=True))
    else:
        columns = rows.columns
    able = marked.withColumn("__able", F.col("__new") & F.col(reason).isNull())
    decided = greedy_distinct(able, order, keys, "__able")
    taken = able.join(decided.where("accepted").select(F.col(order).alias("__taken")), F.col(order) == F.col("__taken"), "left_semi")
    out = able.join(decided, order)
    for key in keys:
        first = taken.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__{key}")).agg(F.min(order).alias(f"__first_{key}"))
        out = out.join(first, out[key] == F.col(f"__{key}"), "left")
    blocked = F.lit(False)
    for key in keys:
        blocked = blocked | F.coalesce(F.col(f"__first_{key}") < F.col(order), F.lit(False))
    return out.select(
        *columns,
        F.when(~F.col("__new"), "dup_existing")
        .when(F.col("accepted"), "accepted")
        .when(blocked, "dup_within")
        .otherwise(F.col(reason))
        .alias("outcome"),
    )
