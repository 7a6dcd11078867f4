"""Counts over the article inventory, with known keys that have no article at zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.functions.session import cut
from brevier.functions.text import column
from brevier.operators import rules as R


def dimension(spark: SparkSession, names: list[str], key: str) -> DataFrame:
    """(ord, key) of a fixed list of names; its size is the list's."""
    pairs = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias(key)) for k, n in enumerate(names)])
    return spark.range(0, 1, 1, 1).select(F.inline(pairs))


def counts(rows: DataFrame, key: str, skip_empty: bool = False, weight: str | None = None) -> DataFrame:
    """(key, cnt), without null and empty keys if asked. weight: a column that tells for how many rows a row stands."""
    kept = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "") if skip_empty else rows
    return kept.groupBy(key).agg((F.sum(weight) if weight else F.count("*")).alias("cnt"))


def zero_filled(rows: DataFrame, key: str, names: list[str], skip_empty: bool = True, weight: str | None = None) -> DataFrame:
    """(ord, key, cnt): every name with its count, zero included, then keys that are no name (ord null)."""
    names_df = dimension(rows.sparkSession, names, key)
    return (
        names_df.join(counts(rows, key, skip_empty, weight), key, "full_outer")
        .select("ord", key, F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    )


def timeline(rows: DataFrame, date: str = "date") -> DataFrame:
    """(date, count) for each day that has rows, ascending."""
    return rows.groupBy(F.col(date).alias("date")).agg(F.count("*").alias("count")).orderBy("date")


def as_map(found: DataFrame, key: str, name: str) -> DataFrame:
    """One row with a map from key to cnt; for a bounded number of keys."""
    return found.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.col("cnt"))))).alias(name)
    )


#: What articles are counted by.
CELL_KEYS = ("category", "brand", "source", "source_type", "date", "product_category")
CELLS = ", ".join(f"{k} string" for k in CELL_KEYS) + ", n long"


def cells(articles: DataFrame, pack: R.RulePack) -> DataFrame:
    """Articles alike in all keys counted together: (keys, n). All statistics are sums of these counts."""
    product = F.coalesce(
        F.when(F.col("product_category") != "", F.col("product_category")), R.classify_product(pack, "title", "summary")
    )
    rows = articles.select(*CELL_KEYS[:-1], product.alias("product_category"))
    return rows.groupBy(*CELL_KEYS).agg(F.count("*").alias("n"))


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed counts that lead from the cells of some articles as they were to those of the same articles as they are.

    before: cells of what was removed or will change; after: of what was added or has changed.
    """
    return added_up(before.withColumn("n", -F.col("n")).unionByName(after))


def added_up(signed: DataFrame) -> DataFrame:
    """Cells of signed counts; those that come to nothing are gone."""
    return signed.groupBy(*CELL_KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def stats_document(articles: DataFrame, pack: R.RulePack, updated: str) -> DataFrame:
    """One row: total, maps by category, brand, source, source type and product, the timeline, and when it was made.

    The articles are read once. Sources are an open domain; a corpus with too many for one map is better served by counts().
    """
    return stats_of_cells(cells(articles, pack), pack, updated)


def stats_of_cells(rows: DataFrame, pack: R.RulePack, updated: str) -> DataFrame:
    """The statistics document of counted articles."""
    rows = cut(rows)
    filled = lambda key, names: as_map(zero_filled(rows, key, names, weight="n"), key, f"by_{key}")
    parts = [
        filled("category", ["competitor", "tech", "market", "brand", "finance"]),
        filled("brand", [b for b, _ in pack.brands]),
        as_map(counts(rows.fillna("Unknown", ["source"]), "source", weight="n"), "source", "by_source"),
        filled("source_type", ["google_news", "official", "press_release"]),
        filled("product_category", ["cardio", "strength", "wearable", "other"]),
        rows.groupBy("date").agg(F.sum("n").alias("count")).agg(F.sort_array(F.collect_list(F.struct("date", "count"))).alias("timeline")),
    ]
    out = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    for part in parts:
        out = out.join(part)  # one row each
    return out.withColumn("updated", F.lit(updated))


def fallback_statistics(articles: DataFrame) -> dict[str, DataFrame]:
    """The same groups as the dashboard recomputes them: no zeros, empty keys left out."""
    return {key: counts(articles, key, skip_empty=True) for key in ("category", "brand", "source")} | {
        "timeline": timeline(articles.where("date <> ''"))
    }


def with_fallback(stored: Column | str, recomputed: Column | str, kind: str = "list") -> Column:
    """A stored value, else the recomputed one.

    A list counts where it has an entry, a map or number where it is there, a text where it is not empty.
    """
    value = column(stored)
    there = {"list": F.size(value) > 0, "text": value != ""}.get(kind, value.isNotNull())
    return F.when(there, value).otherwise(column(recomputed))


def with_stored(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """The statistics of a stored document, one row; each part that it lacks is the recomputed one."""
    have = {f.name: f.dataType.typeName() for f in stored.schema.fields}
    both = recomputed.select(*[F.col(c).alias(f"__{c}") for c in recomputed.columns]).join(stored)
    kinds = {"array": "list", "string": "text"}
    return both.select(
        *[(with_fallback(c, f"__{c}", kinds.get(have[c], "value")) if c in have else F.col(f"__{c}")).alias(c) for c in recomputed.columns]
    )
