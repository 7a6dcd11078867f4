"""The dashboard's queries: filters, search, facets, pages, rankings, shares, heat grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevier.functions.dates import is_same_day, is_within_days
from brevier.operators.stats import dimension, zero_filled

PRODUCTS = ["cardio", "strength", "wearable", "other"]


def in_category(rows: DataFrame, category: str = "all", with_finance: bool = False, column: str = "category") -> DataFrame:
    """One category; `all` leaves finance out unless asked."""
    if category != "all":
        return rows.where(F.col(column) == category)
    return rows if with_finance else rows.where(~F.col(column).eqNullSafe("finance"))


def with_product(rows: DataFrame, product: str = "all", column: str = "product_category") -> DataFrame:
    """Rows of one product class, on top of any other filter; unknown and missing classes are other, "all" keeps every row."""
    if product == "all":
        return rows
    known = F.coalesce(F.when(F.col(column).isin(PRODUCTS), F.col(column)), F.lit("other"))
    return rows.where(known == product)


def lookup(rows: DataFrame, value, key: str = "id") -> DataFrame:
    """The first row with this key, or none; keys are compared as text, as they come from links."""
    return rows.where(F.col(key).cast("string") == F.lit(str(value))).limit(1)


def favourites(rows: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def toggled(chosen, item):
    """An array of ids with an id taken out if it is there, else appended."""
    return F.when(F.array_contains(chosen, item), F.array_remove(chosen, item)).otherwise(F.array_append(chosen, item))


def search(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows whose fields, joined by spaces and lower-cased, hold the lower-cased query; an empty query holds everywhere."""
    if not query:
        return rows
    text = F.lower(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))
    return rows.where(F.contains(text, F.lit(query.lower())))


def translated(rows: DataFrame, memo: DataFrame, text: str) -> DataFrame:
    """rows with the translation of a text column from a memo (text, translated), null without one."""
    return rows.join(memo.select(F.col("text").alias(text), F.col("translated").alias(f"{text}_translated")), text, "left")


def facets(rows: DataFrame, product: str = "product_category") -> DataFrame:
    """(ord, facet, cnt): all, then each product class; unknown classes count as other."""
    known = F.when(F.col(product).isin(PRODUCTS), F.col(product)).otherwise("other")
    counted = rows.select(known.alias("facet")).rollup("facet").agg(F.count("*").alias("cnt"))
    named = counted.select(F.coalesce("facet", F.lit("all")).alias("facet"), "cnt")  # the total has no facet
    return (
        dimension(rows.sparkSession, ["all", *PRODUCTS], "facet")
        .join(named, "facet", "left")
        .select("ord", "facet", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    )


def page(rows: DataFrame, visible: int, *order) -> DataFrame:
    """The first rows in the given order, each with the total, the number shown and the number that remain."""
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).limit(visible)
    return (
        shown.join(total)  # one row
        .withColumn("shown", F.least(F.lit(visible).cast("long"), F.col("total")))
        .withColumn("remaining", F.col("total") - F.col("shown"))
    )


def ranked(found: DataFrame, key: str, n: int, tie: str) -> DataFrame:
    """The n keys of greatest cnt; equal ones in order of the tie column."""
    return found.orderBy(F.desc("cnt"), F.asc_nulls_last(tie), key).limit(n)


def first_seen_counts(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, cnt, first): counts with the smallest position of each key, for ties in order of appearance."""
    return rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(
        F.count("*").alias("cnt"), F.min(position).alias("first")
    )


def top_sources(rows: DataFrame, position: str, n: int = 8, key: str = "source") -> DataFrame:
    return ranked(first_seen_counts(rows, key, position), key, n, "first")


def radar(found: DataFrame, key: str, tie: str, n: int = 8, at_least: int = 3) -> DataFrame:
    """The n greatest non-zero keys, or nothing if fewer than at_least are non-zero."""
    top = ranked(found.where("cnt > 0"), key, n, tie)
    enough = Window.partitionBy(F.lit(1))  # over n rows at most
    return top.withColumn("__n", F.count("*").over(enough)).where(F.col("__n") >= at_least).drop("__n")


def with_share(found: DataFrame, key: str, tie: str, n: int = 8) -> DataFrame:
    """The n greatest keys with their share of all counts in percent, zeros allowed."""
    total = found.agg(F.greatest(F.coalesce(F.sum("cnt"), F.lit(0)), F.lit(1)).alias("__total"))
    return (
        ranked(found, key, n, tie).join(total)  # one row
        .withColumn("share", F.round(F.col("cnt") * 100 / F.col("__total"), 4))
        .drop("__total")
    )


def with_bar(found: DataFrame, floor: float = 6.0) -> DataFrame:
    """Counts of a bounded list as a percentage of the greatest, floored."""
    greatest = F.max("cnt").over(Window.partitionBy(F.lit(1)))
    return found.withColumn("bar", F.greatest(F.lit(floor), F.round(F.col("cnt") * 100 / F.greatest(greatest, F.lit(1)), 4)))


def heat_grid(rows: DataFrame, key: str, date: str, position: str, n: int = 6, days: int = 14) -> DataFrame:
    """(rank, key, day, cnt, intensity): counts of the n greatest keys on each of the last days up to the latest date.

    Intensity is the count over the greatest daily count of those keys on any date, at most 1. Only daily
    counts of the chosen keys are spread over the dense grid of n times days cells.
    """
    dated = rows.where(F.try_to_date(F.col(date).cast("string")).isNotNull()).select(
        F.col(key).alias("key"), F.col(date).cast("string").cast("date").alias("day"), F.col(position).alias("position")
    )
    daily = dated.where("key is not null").groupBy("key", "day").agg(F.count("*").alias("cnt"), F.min("position").alias("first"))
    top = (
        daily.groupBy("key").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first")).orderBy(F.desc("cnt"), "first").limit(n)
        .withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cnt"), "first")))
        .select("rank", "key")
    )
    chosen = daily.join(top, "key")
    peak = chosen.agg(F.max("cnt").alias("peak"))
    axis = dated.agg(F.max("day").alias("last")).select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return (
        top.crossJoin(axis).join(chosen.select("key", "day", "cnt"), ["key", "day"], "left").crossJoin(peak)
        .select(
            "rank", F.col("key").alias(key), F.date_format("day", "yyyy-MM-dd").alias("day"),
            F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"),
            F.round(F.least(F.lit(1.0), F.coalesce("cnt", F.lit(0)) / F.col("peak")), 6).alias("intensity"),
        )
    )


def opacity(intensity):
    return F.when(intensity > 0, F.lit(0.2) + F.lit(0.7) * intensity)


def kpis(rows: DataFrame, date: str, source: str, run_date: str) -> DataFrame:
    """One row: total, today's rows, those of the last seven days, distinct sources."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(is_same_day(date, run_date)).alias("today"),
        F.count_if(is_within_days(date, run_date, 7)).alias("week"),
        F.countDistinct(source).alias("sources"),
    )


def latest(rows: DataFrame, date: str, position: str, n: int = 3) -> DataFrame:
    return rows.orderBy(F.desc(date), position).limit(n)


def tracked(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Tracked names with their counts, zero included, and untracked keys that have rows; greatest first."""
    return zero_filled(rows, key, names).orderBy(F.desc("cnt"), F.asc_nulls_last("ord"), key)


