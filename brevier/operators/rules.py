"""Rule packs, compiled to Columns: which brand, class and product a text is about, and why it is left out.

A pack is data. Each list becomes one fused pattern and each ordered choice one `when` chain, so that the
whole of the rules runs inside generated code, in one pass over the rows, with no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevier.functions.text import any_of, column, contains_any, has_keyword, keyword_pattern, matches_source, strip
from brevier.plans import fitness_pack as pack


def in_either_order(a: str, b: str) -> str:
    return f"(?:{a}.*{b}|{b}.*{a})"


def expand(pattern: str, contexts: dict[str, str]) -> str:
    """A pattern with its {context} filled in and its " & " taken as both, in either order."""
    for name, words in contexts.items():
        pattern = pattern.replace("{" + name + "}", words)
    return in_either_order(*pattern.split(" & ", 1)) if " & " in pattern else pattern


@dataclass(frozen=True)
class RulePack:
    """Everything that classification and exclusion depend on."""

    brands: list[tuple[str, list[str]]]
    own_brands: list[str]
    finance: list[str]
    tech: list[str]
    relevant: list[str]
    products: list[tuple[str, list[str]]]
    off_topic: list[str]
    noise: list[str]
    apparel: list[str]
    exempt: list[str]
    spam_sources: list[str]
    spam: list[str]
    celebrity: list[str]
    brand_context: dict[str, str]
    official_news: str
    official_other: str
    product_off_topic: str
    product_strong: str
    labels: dict[str, str]
    category_nouns: list[str] = field(default_factory=list)
    nav_paths: str = "(?!)"
    article_paths: str = "(?!)"


def words(*lists: list[str]) -> list[str]:
    return [keyword_pattern(k) for each in lists for k in each]


def fitness_rules(with_breakaway: bool = False) -> RulePack:
    """The pack for fitness-equipment news."""
    return RulePack(
        brands=[(name, [expand(p, pack.CONTEXT) for p in patterns]) for name, patterns in pack.BRANDS],
        own_brands=pack.OWN_BRANDS,
        finance=pack.FINANCE,
        tech=pack.TECH,
        relevant=pack.FITNESS,
        products=[("cardio", pack.CARDIO), ("strength", pack.STRENGTH), ("wearable", pack.WEARABLE)],
        off_topic=pack.MILITARY + pack.BALL_SPORT + pack.ORGANIZING + pack.SMART_RING,
        noise=words(pack.CROSS_INDUSTRY) + pack.CROSS_INDUSTRY_PATTERNS + [pack.BREAKAWAY] * with_breakaway,
        apparel=[*words(pack.APPAREL), pack.JERSEY],
        exempt=pack.EQUIPMENT,
        spam_sources=pack.MARKETPLACE_SOURCES,
        spam=pack.MARKETPLACE_PATTERNS,
        celebrity=pack.CELEBRITY,
        brand_context=pack.BRAND_CONTEXT,
        official_news=pack.OFFICIAL_POSITIVE,
        official_other=pack.OFFICIAL_NEGATIVE,
        product_off_topic=pack.OFF_TOPIC_PRODUCT,
        product_strong=pack.STRONG_FITNESS,
        labels=pack.CATEGORY_LABELS,
        category_nouns=pack.CATEGORY_NOUNS,
        nav_paths=pack.NAV_PATHS,
        article_paths=pack.ARTICLE_PATHS,
    )


def body(title: Column | str, summary: Column | str) -> Column:
    return F.concat_ws(" ", F.coalesce(column(title), F.lit("")), F.coalesce(column(summary), F.lit("")))


def first_match(text: Column | str, rules: list[tuple[str, list[str]]]) -> Column:
    """Name of the first rule any of whose patterns the text has; null without one."""
    chain = None
    for name, patterns in rules:
        hit = column(text).rlike(any_of(patterns))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.lit(None).cast("string") if chain is None else chain


def detect_brand(rules: RulePack, text: Column | str) -> Column:
    return first_match(text, rules.brands)


def is_finance(rules: RulePack, text: Column | str) -> Column:
    return has_keyword(text, rules.finance)


def has_brand(brand: Column) -> Column:
    return F.coalesce(brand != "", F.lit(False))


def classify(rules: RulePack, title: Column | str, summary: Column | str, brand: Column | str) -> Column:
    """finance, else brand or competitor by the brand, else tech by substrings, else market."""
    text, brand = F.lower(body(title, summary)), column(brand)
    return (
        F.when(is_finance(rules, text), "finance")
        .when(has_brand(brand) & brand.isin(rules.own_brands), "brand")
        .when(has_brand(brand), "competitor")
        .when(contains_any(text, rules.tech), "tech")
        .otherwise("market")
    )


def category_label(rules: RulePack, category: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules.labels.items() for x in pair]), column(category))


def classify_product(rules: RulePack, title: Column | str, summary: Column | str) -> Column:
    """The first product class with a keyword in the text, else other."""
    named = [(name, words(keywords)) for name, keywords in rules.products]
    return F.coalesce(first_match(body(title, summary), named), F.lit("other"))


def effective_product(rules: RulePack, product: Column | str) -> Column:
    """A known product class, else other."""
    known = [name for name, _ in rules.products]
    return F.when(column(product).isin([*known, "other"]), column(product)).otherwise("other")


def is_relevant(rules: RulePack, text: Column | str) -> Column:
    return has_keyword(text, rules.relevant)


def is_noise(rules: RulePack, text: Column | str) -> Column:
    return column(text).rlike(any_of(rules.noise))


def is_apparel(rules: RulePack, text: Column | str) -> Column:
    """About clothes or shoes, and no equipment named."""
    return column(text).rlike(any_of(rules.apparel)) & ~has_keyword(text, rules.exempt)


def ambiguity(rules: RulePack, text: Column | str, brand: Column | str) -> Column:
    """Why a text with an ambiguous brand is not about it: celebrity_noise or brand_ambiguous_no_context; else null."""
    text, brand = column(text), column(brand)
    chain = F.when(
        brand.isin(list(rules.brand_context)) & text.rlike(any_of(re.escape(k) for k in rules.celebrity)), "celebrity_noise"
    )
    for name, context in rules.brand_context.items():
        chain = chain.when((brand == name) & ~text.rlike(any_of([context])), "brand_ambiguous_no_context")
    return chain


def exclusion_reason(
    rules: RulePack,
    title: Column | str,
    summary: Column | str,
    brand: Column | str,
    source: Column | str,
    relax: Column | bool = False,
) -> Column:
    """The first reason to leave an item out, or null to keep it."""
    text, brand = body(title, summary), column(brand)
    unclear = ambiguity(rules, text, brand)
    relaxed = F.lit(relax) if isinstance(relax, bool) else relax
    return (
        F.when(matches_source(source, rules.spam_sources), "marketplace_spam")
        .when(text.rlike(any_of(rules.spam)), "marketplace_spam")
        .when(unclear.isNotNull(), unclear)
        .when(is_noise(rules, text), "cross_industry_noise")
        .when(is_apparel(rules, text), "apparel_noise")
        .when(~has_brand(brand) & has_keyword(text, rules.off_topic), "off_topic")
        .when(~relaxed & ~has_brand(brand) & ~is_relevant(rules, text), "no_relevance")
    )


def is_official_news(rules: RulePack, title: Column | str) -> Column:
    """News by its title: no sign of advice, and a sign of news."""
    text = strip(F.coalesce(column(title), F.lit("")))
    return ~text.rlike(any_of([rules.official_other])) & text.rlike(any_of([rules.official_news]))


def official_reason(rules: RulePack, source_type: Column | str, title: Column | str, date_is_real: Column | str) -> Column:
    """Why an official item is left out before the other rules; else null."""
    official = F.coalesce(column(source_type), F.lit("google_news")) == "official"
    return F.when(official & ~is_official_news(rules, title), "official_not_news").when(
        official & ~F.coalesce(column(date_is_real), F.lit(False)), "official_no_real_date"
    )


def is_category_title(rules: RulePack, title: Column | str) -> Column:
    """A menu entry rather than a headline: a known noun, or under 22 characters and at most three words."""
    text = strip(F.regexp_replace(F.coalesce(column(title), F.lit("")), r"(?U)\s+", " "))
    count = F.when(text == "", 0).otherwise(F.size(F.split(text, r"(?U)\s+")))
    return F.lower(text).isin(rules.category_nouns) | ((F.length(strip(F.coalesce(column(title), F.lit("")))) < 22) & (count <= 3))


def is_article_path(rules: RulePack, list_path: Column | str, path: Column | str) -> Column:
    """A path below the list's own, or below a section of articles, that is no part of the navigation."""
    own, other = (F.lower(F.regexp_replace(F.coalesce(column(p), F.lit("")), "/+$", "")) for p in (list_path, path))
    full = F.coalesce(column(path), F.lit(""))
    below = other.startswith(F.concat(own, F.lit("/"))) & (F.length(other) > F.length(own) + 1)
    rest = F.regexp_extract(full, rf"(?iUds)^.*?{rules.article_paths}(.*)$", 2)
    section = full.rlike(any_of([rules.article_paths])) & (F.length(F.regexp_replace(rest, "^/+|/+$", "")) >= 3)
    return (other != "") & (other != own) & ~full.rlike(any_of([rules.nav_paths])) & (below | section)


def is_off_topic_product(rules: RulePack, title: Column | str, summary: Column | str, brand: Column | str) -> Column:
    text = body(title, summary)
    return ~has_brand(column(brand)) & text.rlike(any_of([rules.product_off_topic])) & ~text.rlike(any_of([rules.product_strong]))


def is_relaxed(source: Column | str, source_type: Column | str) -> Column:
    """Items of a fixed source that are no search results need not name a relevant word."""
    return F.coalesce(column(source) != "", F.lit(False)) & (F.coalesce(column(source_type), F.lit("google_news")) != "google_news")
