import random
import re

from pyspark.sql import functions as F

from brevier.llm.queries import URL_RULES
from brevier.llm.url_filter import build_cascade, filter_urls, in_cascade


def slow(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = re.search(r"[/?#]|$", rest).start()
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:k]), re.split("[?#]", rest[k:])[0]
    fits = []
    for verdict, key in rules:
        h, p = key.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(key), key, verdict))
    best = max(fits, key=lambda f: (f[0], f[2] == "allow"), default=None)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "https://Example.ORG", "https://example.org/es/1", "https://a.b.example.org/en/12?x#y",
    "https://example.org/en/2", "https://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1#f", "http://com/de/", "a://b://c/d",
    "http://h\nost/pa\nth", "https://x.com:80/de/", "http://..org/", "https://ÄB.com/fr/é",
]


def test_equals_brute_force(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS)] + [(None, "http://x.com/fr/", "y"), (3, URLS[3], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted([tuple(r) for r in filter_urls(pages, URL_RULES).collect()], key=repr)
    assert got == sorted([(i, *slow(u, URL_RULES)) for i, u, _ in rows], key=repr)
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    even = [("block", "b.org/es/"), ("allow", "org/es/1/"), ("block", "x.org/a")]  # the first two are equally long
    both = spark.createDataFrame([(1, "http://b.org/es/1/2"), (2, "http://b.org/es/2"), (3, "http://c.b.org/es/1/")], "page_id long, url string")
    assert sorted(tuple(r) for r in filter_urls(both, even).collect()) == [(i, *slow(u, even)) for i, u in [(r.page_id, r.url) for r in both.collect()]]
    assert filter_urls(pages, []).where("verdict <> 'allow'").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [f"k{rng.getrandbits(40)}" for _ in range(3000)]
    listed = keys[:200]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = build_cascade(listed, universe, 300)  # too small a size is told on purpose: more false positives, more levels
    assert len(levels) > 1
    assert {r.key for r in universe.where(in_cascade(levels, F.col("key"))).collect()} == set(listed)
