"""A rule pack of words that occur in the document tables, so that every rule decides something there."""

from __future__ import annotations

from brevier.operators.rules import RulePack

DEMO = RulePack(
    brands=[
        ("Apache", [r"\bapache license\b"]),
        ("GNU", ["gnu general public license"]),
        ("Idiom", [r"\bidiot\b", r"\bmoron\b"]),
        ("Trash", [r"\btrash\b"]),
        ("Sich", [r"\bsich\b"]),
        ("Pour", [r"\bpour\b"]),
        ("Con", [r"\bcon\b"]),
        ("Mit", ["mit license"]),
    ],
    own_brands=["Apache", "Mit"],
    finance=["worthless", "loser", "10-q"],
    tech=["thing", "sch"],
    relevant=["that", "der", "les", "que"],
    products=[("cardio", ["which", "nicht"]), ("strength", ["from", "pas"]), ("wearable", ["with", "para"])],
    off_topic=["disgusting"],
    noise=["all rights reserved", r"\bscum\b"],
    apparel=[r"\bstupid\b"],
    exempt=["clown"],
    spam_sources=["src13"],
    spam=["cc by-nc"],
    celebrity=["pathetic"],
    brand_context={"Idiom": "that.*with", "Trash": "this"},
    official_news=r"\bthis\b",
    official_other=r"\byou\b",
    product_off_topic=r"\bscum\b",
    product_strong=r"\bthat\b",
    labels={"competitor": "Competitors", "tech": "Technology", "market": "Markets", "brand": "Own brands", "finance": "Finance"},
    category_nouns=["the", "der"],
    nav_paths=r"/(tag|page|search)(/|$|\.html)",
    article_paths="/(en|fr|de)/",
)
