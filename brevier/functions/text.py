"""String functions as Columns. Python's Unicode notions of space, word and case hold throughout."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive, Unicode classes and boundaries, and a dot that excludes \n alone.
FLAGS = "(?iUd)"
#: White space as Python strips it: Unicode's, and the four information separators.
SPACE = r"[\s\x1C-\x1F]"


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(column(text), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def either(first: Column | str, *others: Column | str) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    *tests, last = [column(c) for c in (first, *others)]
    return F.coalesce(*[F.when(c != "", c) for c in tests], last)


def any_of(patterns: Iterable[str]) -> str:
    """One regular expression that finds any of the patterns."""
    return FLAGS + "(?:" + "|".join(patterns) + ")"


def keyword_pattern(keyword: str) -> str:
    """A keyword of ASCII letters and digits matches as a word, any other as a substring."""
    return rf"\b{keyword}\b" if re.fullmatch("[a-zA-Z0-9]+", keyword) else re.escape(keyword)


def has_keyword(text: Column | str, keywords: Iterable[str]) -> Column:
    """True where the text has any of the keywords: one fused pattern, one pass."""
    return column(text).rlike(any_of(keyword_pattern(k) for k in keywords))


def contains_any(text: Column | str, needles: Iterable[str]) -> Column:
    """True where the text has any of the needles as a plain substring; for lower-cased text."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(column(text), F.lit(needle))
    return found


def title_key(title: Column | str) -> Column:
    """Lower case, stripped, without punctuation and marks, white space collapsed: equal for titles that say the same."""
    bare = F.regexp_replace(strip(F.lower(column(title))), r"(?U)[^\p{L}\p{N}_\s\x1C-\x1F]", "")
    return F.regexp_replace(bare, rf"(?U){SPACE}+", " ")


def url_key(url: Column | str) -> Column:
    """Up to the first ?, without trailing slashes, in lower case. A fragment stays."""
    return F.lower(F.regexp_replace(F.substring_index(column(url), "?", 1), "/+$", ""))


def title_and_source(title: Column | str) -> Column:
    """struct(title, source): halves at the last " - "; where one is empty, the whole and "Unknown"."""
    whole = strip(column(title))
    left = strip(F.regexp_extract(whole, r"(?s)^(.*) - (.*)$", 1))
    right = strip(F.regexp_extract(whole, r"(?s)^(.*) - (.*)$", 2))
    both = (left != "") & (right != "")
    return F.struct(
        F.when(both, left).otherwise(whole).alias("title"), F.when(both, right).otherwise(F.lit("Unknown")).alias("source")
    )


def matches_source(source: Column | str, names: Iterable[str]) -> Column:
    """True where the stripped, lower-cased source has any of the names in it."""
    return contains_any(F.coalesce(F.lower(strip(source)), F.lit("")), names)


def is_official_source(source: Column | str) -> Column:
    return F.coalesce(column(source), F.lit("")).endswith("官方")


def escape_html(text: Column | str) -> Column:
    """& < > and the double quote as entities; null as the empty string."""
    out = F.coalesce(column(text), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def percent_encode(text: Column | str) -> Column:
    """Percent-encoding of UTF-8 that leaves letters, digits and _.-~/ as they are."""
    out = F.url_encode(column(text))
    for form, url in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(url))
    return out


def url_host(url: Column | str) -> Column:
    """Host without any `www.`; null for a malformed URL."""
    return F.replace(F.try_parse_url(column(url), F.lit("HOST")), F.lit("www."), F.lit(""))


def url_path(url: Column | str) -> Column:
    return F.try_parse_url(column(url), F.lit("PATH"))


def localised(original: Column | str, translated: Column | str) -> Column:
    """The translation if there is one, else the original, else the empty string."""
    return F.coalesce(column(translated), column(original), F.lit(""))


def display_time(value: Column | str) -> Column:
    """YYYY-MM-DD HH:mm, or the value itself where it is no time."""
    return F.coalesce(F.date_format(F.try_to_timestamp(column(value)), "yyyy-MM-dd HH:mm"), column(value))


def nfkc(text: Column | str) -> Column:
    """Unicode normal form KC, by an Arrow batch function: Spark has none of its own."""

    @F.arrow_udf("string")
    def normalise(values: pa.Array) -> pa.Array:
        texts = (v.as_py() for v in values)
        return pa.array((t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts), pa.string())

    return normalise(column(text))


class TextParser(HTMLParser):
    """Collects visible text."""

    HIDDEN = ("script", "style", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(raw: str | None) -> str:
    """Text of markup whose entities are decoded first, parts joined and white space collapsed to one space."""
    if not raw:
        return ""
    parser = TextParser()
    parser.feed(html.unescape(raw))
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def clean_html(raw: Column | str) -> Column:
    """Visible text of HTML, by an Arrow batch function."""

    @F.arrow_udf("string")
    def clean(values: pa.Array) -> pa.Array:
        return pa.array((visible_text(v.as_py()) for v in values), pa.string())

    return clean(column(raw))
