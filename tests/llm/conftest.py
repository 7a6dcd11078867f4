import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, key string, grp int"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    words = ["the", "of", "house", "river", "stone", "light", "walks", "über", "naïve", "Tree.", "run,", "night"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(n))
    shared = prose(60)
    texts = [
        None, "", "   \n\t ", "a", "one two three", shared, shared, prose(300) + "\n" + shared + "\n" + prose(20),
        "the " * 500, prose(4000), "Same line here.\n" * 30, "x" * 100_000, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600 end",
        "1234 5678 !!!", shared.upper(),
    ]
    rows = [(k, t, "en" if k % 2 else "de", f"src{k % 3}", len(t or ""), "z", k, "k", 1) for k, t in enumerate(texts)]
    rows += [(k, prose(40), "en" if k % 3 else None, "src0", 1, None, None, None, None) for k in range(20, 60)]
    rows += [rows[5], rows[7], (None, shared, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
