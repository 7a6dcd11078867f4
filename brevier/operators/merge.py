"""Incremental maintenance of the article inventory: new items in, stale noise out, ids stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevier.functions.dates import is_too_old
from brevier.functions.session import cut, spread
from brevier.functions.text import either, is_official_source, nfkc, strip, title_and_source, title_key, url_key
from brevier.operators import rules as R
from brevier.operators.dedupe import outcomes
from brevier.operators.matcher import Rules

ARTICLE = (
    "id long, title string, url string, source string, date string, category string, categoryName string, "
    "brand string, summary string, source_type string, first_seen string, product_category string"
)
COLUMNS = [f.split()[0] for f in ARTICLE.split(", ")]


def running_number(rows: DataFrame, order: str | list[str | Column], name: str, per_bucket: int = 100_000) -> DataFrame:
    """rows with name: 1, 2, ... in the given order, without one task that sees all rows.

    Rows are dealt by ranges of the order; ranges are counted, and their counts summed up in one small window.
    """
    by = [order] if isinstance(order, str) else order
    ranges = max(1, -(-rows.count() // per_bucket))
    dealt = cut(rows.repartitionByRange(ranges, *by).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__range").orderBy(*by)
    return (
        dealt.join(base, "__range")
        .withColumn(name, F.col("__base") + F.row_number().over(own))
        .drop("__range", "__base")
    )


def prepare(raw: DataFrame, run_date: str) -> DataFrame:
    """Raw items as rows with their parts and keys, whose contents `judge` then reads.

    raw: seq, raw_title, link, summary, date, date_is_real, source_type, brand, source. Items without a title
    or a link are dropped.
    """
    items = raw.select(
        "seq", strip("raw_title").alias("raw_title"), strip("link").alias("link"), "summary", "date", "date_is_real",
        F.coalesce("source_type", F.lit("google_news")).alias("source_type"), "brand",
        F.col("source").alias("fixed_source"),
    ).where((F.col("raw_title") != "") & (F.col("link") != ""))
    fixed = R.has_brand(F.col("fixed_source"))
    whole = items.withColumn("__nfkc", nfkc("raw_title"))
    parts = whole.withColumn("__parts", title_and_source("__nfkc")).select(
        "*",
        F.when(fixed, strip("__nfkc")).otherwise(F.col("__parts.title")).alias("title"),
        F.when(fixed, F.col("fixed_source")).otherwise(F.col("__parts.source")).alias("new_source"),
    )
    return parts.select(
        "seq", "title", F.col("link").alias("url"), F.col("new_source").alias("source"),
        either("date", F.lit(run_date)).alias("date"), either("summary", "title").alias("summary"), "source_type",
        "date_is_real", F.col("brand").alias("set_brand"), "fixed_source", url_key("link").alias("url_key"),
        title_key("title").alias("title_key"),
    )


def judge(read: DataFrame, pack: R.RulePack, run_date: str, max_age_days: int = 740) -> DataFrame:
    """Rows of `prepare` as candidate articles: brand, class and the reason to leave them out, if any; one pass reads a text."""
    rules = Rules(pack)
    scanned = spread(read).withColumn("__hits", rules.hits("title", "summary"))
    branded = scanned.withColumn("brand", either("set_brand", rules.brand("__hits")))
    reason = F.coalesce(
        R.official_reason(pack, "source_type", "title", "date_is_real"),
        rules.exclusion_reason("__hits", "brand", "source", R.is_relaxed("fixed_source", "source_type")),
        F.when(is_too_old("date", run_date, max_age_days), "too_old"),
    )
    category = rules.category("__hits", "brand")
    return branded.select(
        "seq", "title", "url", "source", "date", category.alias("category"),
        R.category_label(pack, category).alias("categoryName"), "brand", "summary", "source_type",
        F.lit(run_date).alias("first_seen"), rules.product("__hits").alias("product_category"),
        "url_key", "title_key", reason.alias("reason"),
    )


def new_articles(judged: DataFrame, max_id: int) -> DataFrame:
    """Accepted rows with ids from max_id + 1 in order of arrival."""
    accepted = judged.where("outcome = 'accepted'")
    numbered = running_number(accepted, "seq", "__number")
    return numbered.select((F.lit(max_id) + F.col("__number")).cast("long").alias("id"), *COLUMNS[1:])


def report(judged: DataFrame) -> DataFrame:
    """(outcome, n): how many rows were accepted, too old, duplicates or left out for a reason."""
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


def clean_actions(articles: DataFrame, pack: R.RulePack, run_date: str, refetched: DataFrame | None = None) -> DataFrame:
    """articles with action: keep, date_corrected, product_to_gnews or why the row goes, and values as corrected.

    refetched: (url, real_date) of official rows whose date was the day of their listing; of a URL fetched more than once
    the latest date counts.
    """
    rows = articles
    if refetched is not None:
        rows = rows.join(refetched.groupBy("url").agg(F.max("real_date").alias("real_date")), "url", "left")
    else:
        rows = rows.withColumn("real_date", F.lit(None).cast("string"))
    kind = F.coalesce("source_type", F.lit("google_news"))
    official = (kind == "official") | ((kind == "product") & is_official_source("source"))
    product = (kind == "product") & ~official
    undated = ~R.has_brand(F.col("date")) | (F.col("date") == run_date)
    unclear = R.ambiguity(pack, R.body("title", "summary"), F.col("brand"))
    first = (
        F.when(official & ~R.is_official_news(pack, "title"), "removed_howto")
        .when(official & undated & F.col("real_date").isNull(), "removed_no_real_date")
        .when(product & R.is_off_topic_product(pack, "title", "summary", "brand"), "removed_offtopic")
    )
    second = F.when(unclear == "celebrity_noise", "removed_celebrity_noise").when(unclear.isNotNull(), "removed_brand_ambiguous")
    change = F.when(official & undated, "date_corrected").when(product, "product_to_gnews").otherwise("keep")
    category = F.when(product, R.classify(pack, "title", "summary", "brand")).otherwise(F.col("category"))
    return (
        rows.withColumn("change", F.when(first.isNull(), change))
        .withColumn("action", F.coalesce(first, second, change))
        .withColumn("date", F.when(official & undated & F.col("real_date").isNotNull(), F.col("real_date")).otherwise(F.col("date")))
        .withColumn("category", category)
        .withColumn("categoryName", F.when(product, R.category_label(pack, F.col("category"))).otherwise(F.col("categoryName")))
        .withColumn("source_type", F.when(official, "official").when(product, "google_news").otherwise(F.col("source_type")))
        .drop("real_date")
    )


def cleaning_report(actions: DataFrame, n_samples: int = 40) -> DataFrame:
    """One row: a counter for each action, their total, and the first titles with an action, in order of id."""
    removed = ["howto", "offtopic", "no_real_date", "celebrity_noise", "brand_ambiguous"]
    count = lambda test: F.count_if(test).alias
    counts = [count(F.col("action") == f"removed_{r}")(f"removed_{r}") for r in removed]
    changed = [count(F.col("change") == c)(c) for c in ("date_corrected", "product_to_gnews")]
    total = F.count_if(F.col("action").startswith("removed_")).alias("removed_total")
    notable = actions.where("action <> 'keep'").orderBy("id").limit(n_samples)
    samples = notable.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("id", F.concat(F.lit("["), F.col("action"), F.lit("] "), F.substring("title", 1, 60)).alias("text")))),
            lambda s: s["text"],
        ).alias("samples")
    )
    return actions.agg(*counts, *changed, total).join(samples)


def merge(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing rows and new ones, the latest dates first; rows of a date in order of id."""
    both = existing.select(*COLUMNS).unionByName(fresh.select(*COLUMNS))
    return both.orderBy(F.desc("date"), "id")


def keyed(articles: DataFrame) -> DataFrame:
    return articles.withColumn("url_key", url_key("url")).withColumn("title_key", title_key("title"))


def run_pipeline(
    existing: DataFrame, raw: DataFrame, pack: R.RulePack, run_date: str, refetched: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The daily job: clean the inventory, judge and number new items, merge. Existing rows win over new ones.

    last_id: the greatest id given so far, which a row that is cleaned away may have had.
    """
    max_id = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    actions = cut(clean_actions(existing, pack, run_date, refetched))
    kept = actions.where(~F.col("action").startswith("removed_")).select(*COLUMNS)
    judged = cut(outcomes(prepare(raw, run_date), keyed(kept), judge=lambda rows: judge(rows, pack, run_date)))
    fresh = new_articles(judged, max_id)
    return {
        "articles": merge(kept, fresh),
        "added": fresh,
        "last_id": judged.agg((F.lit(max_id) + F.count_if(F.col("outcome") == "accepted")).cast("long").alias("last_id")),
        "report": report(judged),
        "cleaned": cleaning_report(actions),
    }


def fill_defaults(rows: DataFrame, pack: R.RulePack, run_date: str) -> DataFrame:
    """Rows of an older or partial corpus with every column of an article, missing values filled in."""
    have = set(rows.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    title, category = F.coalesce(col("title"), F.lit("")), F.coalesce(col("category"), F.lit("market"))
    summary = F.coalesce(col("summary"), title)
    date = F.coalesce(col("date"), F.lit(run_date))
    return rows.select(
        col("id").cast("long").alias("id"), title.alias("title"), F.coalesce(col("url"), F.lit("")).alias("url"),
        F.coalesce(col("source"), F.lit("Unknown")).alias("source"), date.alias("date"), category.alias("category"),
        F.coalesce(col("categoryName"), R.category_label(pack, category)).alias("categoryName"),
        col("brand").alias("brand"), summary.alias("summary"),
        F.coalesce(col("source_type"), F.lit("google_news")).alias("source_type"),
        either(col("first_seen"), col("date"), F.lit(run_date)).alias("first_seen"),
        either(col("product_category"), R.classify_product(pack, title, summary)).alias("product_category"),
    )
