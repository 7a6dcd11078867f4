"""Feed catalogue, landed feeds and pages as raw items, and the choice among a brand's sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevier.functions.dates import published_date
from brevier.functions.session import cut
from brevier.functions.text import clean_html, either, percent_encode, strip
from brevier.operators.merge import running_number
from brevier.operators.stats import dimension
from brevier.plans import fitness_pack as pack

ITEM = "title string, link string, description string, summary string, pubDate string, published string, updated string"
RAW = "seq long, raw_title string, link string, summary string, date string, date_is_real boolean, source_type string, brand string, source string"


def queries_from(names: DataFrame, templates: DataFrame) -> DataFrame:
    """(block, ord, place, query): every template filled in with every name; a pair of short lists."""
    return names.crossJoin(templates).select(
        "block", F.col("ord"), "place", F.replace(F.col("template"), F.lit("{name}"), F.col("name")).alias("query")
    )


def search_block(spark: SparkSession, block: int, names: list[str], templates: list[str]) -> DataFrame:
    left = dimension(spark, names, "name")
    right = dimension(spark, templates, "template").withColumnRenamed("ord", "place").withColumn("block", F.lit(block))
    return queries_from(left, right)


def feed_catalog(spark: SparkSession) -> DataFrame:
    """(seq, url, source_type, brand, source): all feeds to read, the first of those with one URL and type."""
    blocks = [
        (pack.QUERY_BRANDS, ['"{name}" when:1y', "{name} fitness when:1y", "{name} treadmill when:1y", "{name} equipment when:1y"], "en", "google_news"),
        (pack.PUBLIC_BRANDS, ["{name} stock when:1y", "{name} earnings when:1y"], "en", "google_news"),
        (pack.LOW_VOLUME_BRANDS, ['"{name}" when:2y'], "en", "google_news"),
        (pack.GENERIC_QUERIES, ["{name} when:1y"], "en", "google_news"),
        (pack.TAIWAN_QUERIES, ["{name} when:1y"], "tw", "google_news"),
        (pack.CHINA_QUERIES, ["{name}"], "cn", "google_news"),
        (pack.QUERY_BRANDS, [t + " when:1y" for t in pack.PRODUCT_TEMPLATES], "en", "google_news"),
        (pack.PRESS_QUERIES, ["{name} when:1y"], "en", "press_release"),
    ]
    form = {"en": pack.SEARCH_EN, "tw": pack.SEARCH_TW, "cn": pack.SEARCH_CN}
    parts = [
        search_block(spark, k, names, templates).select(
            "block", "ord", "place",
            F.replace(F.lit(form[region]), F.lit("{q}"), percent_encode("query")).alias("url"),
            F.lit(kind).alias("source_type"), F.lit(None).cast("string").alias("source"),
        )
        for k, (names, templates, region, kind) in enumerate(blocks)
    ]
    feeds = F.array(*[F.struct(F.lit(f["url"]).alias("url"), F.lit(f["source"]).alias("source")) for f in pack.PRESS_FEEDS])
    direct = spark.range(0, 1, 1, 1).select(F.inline(feeds)).select(
        F.lit(len(blocks)).alias("block"), F.lit(0).alias("ord"), F.lit(0).alias("place"), "url",
        F.lit("press_release").alias("source_type"), "source",
    )
    every = direct
    for part in parts:
        every = part.unionByName(every)
    first = Window.partitionBy("url", "source_type").orderBy("block", "ord", "place")
    kept = every.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    order = Window.partitionBy(F.lit(1)).orderBy("block", "ord", "place")  # a few hundred rows
    return kept.select(
        F.row_number().over(order).cast("long").alias("seq"), "url", "source_type", F.lit(None).cast("string").alias("brand"), "source"
    )


def story_sources(spark: SparkSession) -> DataFrame:
    """(brand, kind, priority, url): a brand's feeds, then its pages, in the order in which they are tried."""
    rows = [
        (brand, kind, k, url)
        for brand, found in pack.STORY_SOURCES.items()
        for k, (kind, url) in enumerate([("feed", u) for u in found["feeds"]] + [("page", u) for u in found["pages"]])
    ]
    fields = ("brand", "kind", "priority", "url")
    return spark.range(0, 1, 1, 1).select(
        F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, fields, strict=True)]) for r in rows]))
    )


def read_feed_files(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of landed RSS (item) or Atom (entry) files, with the file that each is from."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(ITEM).load(path).withColumn("file", F.input_file_name())


def entries_of(landed: DataFrame, body: str = "body", tag: str = "item") -> DataFrame:
    """landed (url, body, ...) with one row for each entry of its feed."""
    entries = F.regexp_extract_all(F.col(body), F.lit(rf"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))
    return landed.select(*[c for c in landed.columns if c != body], F.posexplode(entries).alias("ord", "__xml")).select(
        "*", F.from_xml("__xml", ITEM, {"rowTag": tag}).alias("__e")
    ).select(*[c for c in landed.columns if c != body], "ord", "__e.*")


def raw_items(entries: DataFrame, run_date: str, *order: str) -> DataFrame:
    """Entries as raw items, numbered in the given order or as they come.

    Those without a title or a link are dropped, and a missing date is the run date.
    """
    real = published_date(either("published", "pubDate"), "updated")
    kept = entries.where((strip("title") != "") & (strip("link") != ""))
    # Numbers take several passes over the rows, of which each would parse the feeds anew.
    numbered = running_number(cut(kept), list(order), "__seq") if order else kept.withColumn("__seq", F.monotonically_increasing_id())
    return numbered.select(
        F.col("__seq").cast("long").alias("seq"), strip("title").alias("raw_title"), strip("link").alias("link"),
        clean_html(either("summary", "description")).alias("summary"), F.coalesce(real, F.lit(run_date)).alias("date"),
        real.isNotNull().alias("date_is_real"), "source_type", "brand", "source",
    )


def feed_status(catalog: DataFrame, landed: DataFrame) -> DataFrame:
    """catalog with ok: whether a feed has landed."""
    have = landed.select(F.col("url").alias("__url")).distinct().withColumn("ok", F.lit(True))
    return catalog.join(have, catalog["url"] == F.col("__url"), "left").drop("__url").withColumn("ok", F.coalesce("ok", F.lit(False)))


def source_lists(feeds: DataFrame, stories: DataFrame) -> DataFrame:
    """One row: sources_ok and sources_failed, feeds in order of the catalogue and then brands in theirs.

    feeds: (seq, url, ok); stories: (ord, brand, ok, url). Both are bounded by the catalogue.
    """
    official = F.concat(F.lit("official:"), "brand", F.when(F.col("ok"), F.concat(F.lit(":"), F.coalesce("url", F.lit("")))).otherwise(""))
    both = feeds.select(F.lit(0).alias("part"), F.col("seq").cast("long").alias("at"), F.col("url").alias("name"), "ok").unionByName(
        stories.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("at"), official.alias("name"), "ok")
    )

    def listed(chosen: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(chosen, F.struct("part", "at", "name")))), lambda x: x["name"])

    return both.agg(listed(F.col("ok")).alias("sources_ok"), listed(~F.col("ok")).alias("sources_failed"))


def first_source(items: DataFrame, brands: DataFrame, brand: str = "brand", priority: str = "priority") -> DataFrame:
    """Items of each brand's first source that has any; brands without one appear once, with kind `none`."""
    best = items.groupBy(brand).agg(F.min(priority).alias("__best"))
    chosen = items.join(best, brand).where(F.col(priority) == F.col("__best")).drop("__best")
    return brands.select(brand).join(chosen, brand, "left").withColumn("kind", F.coalesce("kind", F.lit("none")))
