"""Table functions over HTML: article links of a listing page, candidate publication dates of an article.

Python only parses markup, in Arrow batches; every decision about what was found is a Column.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brevier.functions.dates import normalise_date
from brevier.functions.session import spread
from brevier.functions.text import column, url_host, url_key, url_path
from brevier.operators import rules as R

LINK = "ord int, text string, href string"
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Metadata that tells a date, in the order in which it is tried.
META = [
    ("property", "article:published_time"), ("name", "article:published_time"), ("itemprop", "datePublished"),
    ("name", "parsely-pub-date"), ("name", "publishdate"), ("name", "publish-date"), ("name", "pubdate"), ("name", "date"),
]
LATER_META = [("property", "og:updated_time"), ("property", "og:published_time")]
JSON_KEYS = ("datePublished", "dateCreated", "datePosted", "uploadDate")
DATE_CLASSES = ("published", "post-date", "entry-date", "article-date", "date")


class Tree(HTMLParser):
    """Elements in document order as [tag, attributes, text parts, whether in navigation, parent]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        inside = bool(self.open) and self.elements[self.open[-1]][3]
        nav = inside or tag in ("nav", "header", "footer") or found.get("role") == "navigation"
        self.elements.append([tag, found, [], nav, self.open[-1] if self.open else None])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[k]][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if not data.strip():
            return
        hidden = self.open and self.elements[self.open[-1]][0] in ("script", "style", "template")
        for k in self.open[-1:] if hidden else self.open:
            self.elements[k][2].append(data.strip())


def parse(html: str | None) -> Tree:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree


def anchors(html: str | None, base: str | None, drop_nav: bool) -> list[dict]:
    """Links outside of navigation, in order: place, text and absolute URL."""
    out = []
    for tag, attrs, parts, nav, _ in parse(html).elements:
        href = attrs.get("href", "").strip()
        if tag != "a" or not href or (nav and drop_nav) or href.lower().startswith(("javascript:", "mailto:", "tel:", "#")):
            continue
        try:
            absolute = urljoin(base or "", href)
        except ValueError:
            continue
        out.append({"ord": len(out), "text": " ".join(parts), "href": absolute})
    return out


def json_date(value) -> str | None:
    """The first date key in a depth-first walk; an object's own keys come before what lies below."""
    todo = [value]
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            for key in JSON_KEYS:
                if at.get(key):
                    return str(at[key])
            todo += reversed(list(at.values()))
        elif isinstance(at, list):
            todo += reversed(at)
    return None


def date_candidates(html: str | None) -> list[dict]:
    """(stage, ord, raw) in the order in which candidates are tried."""
    elements = parse(html).elements
    out: list[dict] = []

    def add(stage: int, raw) -> None:
        if raw:
            out.append({"stage": stage, "ord": len(out), "raw": str(raw)})

    def metas(stage: int, keys) -> None:
        for attr, value in keys:
            first = next((a for t, a, *_ in elements if t == "meta" and a.get(attr) == value), None)
            add(stage, first and first.get("content"))

    metas(1, META)
    for tag, attrs, parts, *_ in elements:
        if tag == "script" and attrs.get("type") == "application/ld+json":
            try:
                add(2, json_date(json.loads(" ".join(parts))))
            except (ValueError, RecursionError):
                continue
    for tag, attrs, parts, *_ in elements:
        if tag == "time":
            add(3, attrs.get("datetime") or " ".join(parts))
    metas(4, LATER_META)
    for _, attrs, parts, *_ in elements:
        if any(c in attrs.get("class", "").lower() for c in DATE_CLASSES):
            add(5, " ".join(parts))
    return out


#: Pages whose links a worker holds at a time, before it passes them on.
PAGES_AT_ONCE = 128


def links(pages: DataFrame, url: str = "url", html: str = "html", drop_nav: bool = True) -> DataFrame:
    """pages, dealt over all cores, with one row for each link: ord, text, href.

    A worker holds a batch as it came and the links of a few of its pages.
    """
    others = [c for c in pages.columns if c != html]
    schema = T.StructType([*[f for f in pages.schema.fields if f.name != html], *T.StructType.fromDDL(LINK).fields])

    def find(batches):
        for batch in batches:
            bodies, bases, kept = batch.column(html), batch.column(url), batch.select(others)
            for low in range(0, batch.num_rows, PAGES_AT_ONCE):
                rows, found = [], []
                for k in range(low, min(batch.num_rows, low + PAGES_AT_ONCE)):
                    new = anchors(bodies[k].as_py(), bases[k].as_py(), drop_nav)
                    rows += [k] * len(new)
                    found += new
                own = kept.take(pa.array(rows, pa.int64()))
                more = [pa.array([x[c] for x in found], t) for c, t in (("ord", pa.int32()), ("text", pa.string()), ("href", pa.string()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*others, "ord", "text", "href"])

    return spread(pages).mapInArrow(find, schema)


def article_links(
    pages: DataFrame, pack: R.RulePack, url: str = "url", html: str = "html", min_length: int = 25, most: int = 20, drop_nav: bool = True
) -> DataFrame:
    """(url, ord, text, href) of the links of each listing page that lead to articles of its own site.

    The first of those with one key stays, and the first `most` of a page; both are features of the listing.
    """
    own, other = url_host(url), url_host("href")
    found = links(pages.select(url, html), url, html, drop_nav).where(
        (F.length("text") >= min_length)
        & F.col("href").rlike("^https?://")
        & F.contains(F.coalesce(other, F.lit("")), F.coalesce(own, F.lit("")))
        & R.is_article_path(pack, url_path(url), url_path("href"))
        & ~R.is_category_title(pack, "text")
        & R.is_official_news(pack, "text")
    )
    by_key = Window.partitionBy(url, url_key("href")).orderBy("ord")
    by_page = Window.partitionBy(url).orderBy("ord")
    return (
        found.withColumn("__copy", F.row_number().over(by_key)).where("__copy = 1").drop("__copy")
        .withColumn("__place", F.row_number().over(by_page)).where(F.col("__place") <= most).drop("__place")
    )


def published_dates(pages: DataFrame, run_date: str, html: str = "html") -> DataFrame:
    """pages with real_date: the first candidate that is a valid date, null without one."""

    kind = pa.list_(pa.struct([("stage", pa.int32()), ("ord", pa.int32()), ("raw", pa.string())]))

    @F.arrow_udf("array<struct<stage: int, ord: int, raw: string>>")
    def candidates(bodies: pa.Array) -> pa.Array:
        return pa.array((date_candidates(b.as_py()) for b in bodies), kind)

    valid = F.filter(F.transform("__raw", lambda c: normalise_date(c["raw"], run_date)), lambda d: d.isNotNull())
    return pages.withColumn("__raw", candidates(column(html))).withColumn("real_date", F.get(valid, F.lit(0))).drop("__raw")
