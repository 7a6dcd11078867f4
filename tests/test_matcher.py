"""The one-pass matcher against the patterns one by one."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from brevier.operators import matcher as M
from brevier.operators import rules as R
from brevier.plans import fitness_pack as values
from brevier.plans.demo import DEMO

FITNESS = R.fitness_rules()


def composed(rng):
    """Titles of all brands, keywords and contexts of the pack amid noise, cut and joined so that words touch others."""
    names = [*values.QUERY_BRANDS, *values.TRACKED_BRANDS, "sole F63", "SHUA", "舒華", "喬山", "proform", "Cybex eagle", "nautilus, inc", "iFit for your ProForm", "St. Louis True Fitness", "schwinn IC4"]
    lists = (values.FINANCE, values.TECH, values.FITNESS, values.WEARABLE, values.STRENGTH, values.MILITARY, values.BALL_SPORT, values.SMART_RING, values.CROSS_INDUSTRY, values.APPAREL, values.EQUIPMENT, values.CELEBRITY, values.ORGANIZING)
    words = [w for each in lists for w in each]
    noise = ["replacement part", "for parts", "new jersey", "Jersey City", "jerseys", "tonal shift", "playing with tonal", "vintage schwinn", "lego", "police", "nautilus 的車款", "fınance", "ſtock", "BİKE", "\u212aettlebell", "gym\u200d", "Kettlebell", "élite", "gyḿ", "plate_", "_app", "10-K!", "\n", "x" * 30]
    glue = [" ", " ", " ", "-", "", ", ", "　", ".", "́", "é"]
    for _ in range(3000):
        parts = [rng.choice(names), *rng.choices(words, k=rng.randrange(4)), *rng.choices(noise, k=rng.randrange(2))]
        rng.shuffle(parts)
        text = "".join(p + rng.choice(glue) for p in parts)
        yield text.upper() if rng.random() < 0.2 else text
    yield from (None, "", *words, *names)


@pytest.mark.parametrize("pack", [FITNESS, DEMO], ids=["fitness", "demo"])
def test_rules_equal_the_patterns(spark, pack):
    texts = [*composed(random.Random(5))]
    brands = [name for name, _ in pack.brands] + [None, ""]
    rows = [(t, texts[-k] if k % 7 == 0 else None, brands[k % len(brands)], "x ebay" if k % 50 == 0 else "src") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "title string, summary string, brand string, source string").repartition(4)
    if pack is DEMO:
        docs = docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text", F.lit(None).cast("string"), "source"))
    one = M.Rules(pack)
    text = R.body("title", "summary")
    kinds = {
        "brand": (R.detect_brand(pack, text), one.brand("hits")),
        "category": (R.classify(pack, "title", "summary", "brand"), one.category("hits", "brand")),
        "product": (R.classify_product(pack, "title", "summary"), one.product("hits")),
        "reason": (R.exclusion_reason(pack, "title", "summary", "brand", "source"), one.exclusion_reason("hits", "brand", "source")),
        "off topic": (R.is_off_topic_product(pack, "title", "summary", "brand"), one.is_off_topic_product("hits", "brand")),
        "apparel": (R.is_apparel(pack, text), one.has("hits", "apparel") & ~one.has("hits", "exempt")),
        **{f"list {name}": (F.lower(text).rlike(R.any_of(patterns)) if name == "tech" else text.rlike(R.any_of(patterns)), one.has("hits", name)) for name, patterns in one.lists.items()},
    }
    hit = docs.withColumn("hits", one.hits("title", "summary"))
    both = hit.select("title", "summary", F.array([F.struct(F.lit(k).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b")) for k, (a, b) in kinds.items()]).alias("k"))
    unlike = both.select("title", "summary", F.inline("k")).where("NOT (a <=> b)")
    assert [tuple(r) for r in unlike.limit(5).collect()] == []


def test_a_text_is_scanned_once(spark):
    """Filters on what follows from the bits don't scan the text again."""
    one = M.Rules(DEMO)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("hits", one.hits("lang", "text"))
    rows = docs.withColumn("brand", one.brand("hits")).withColumn("category", one.category("hits", "brand"))
    plan = rows.where("category <> 'finance' AND brand IS NULL").groupBy("category").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "rlike" not in plan.lower()


def test_phrases_and_what_patterns_need():
    parse = lambda p: M.needed(M.re._parser.parse(p, M.re.I))
    assert M.phrase(r"\bgym\b") == ("gym", True, True) and M.phrase(r"10\-k") == ("10-k", False, False) and M.phrase("a.b") is None
    assert sorted(parse("matrix (gym|bike)s?")) == ["matrix "] and sorted(parse("(alpha|beta.x){1,2}q")) == ["alpha", "beta"]
    assert parse(r"\d+") is None and parse("(a|b?)c*") is None
    with pytest.raises(ValueError):
        M.Scanner({str(k): ["x"] for k in range(63)})
    assert M.Scanner({"none": []}).scan("anything") == 0


def test_texts_leave_arrow_one_at_a_time(spark):
    """A worker holds no second copy of a batch's texts: hits are scanned from Arrow's own."""
    rows = spark.createDataFrame([(1, "Peloton treadmill", None), (2, "", "x")], "id long, title string, summary string")
    hit = rows.select("id", M.Rules(FITNESS).hits("title", "summary").alias("hits"))
    assert [r.hits != 0 for r in hit.orderBy("id").collect()] == [True, False]
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in hit._jdf.queryExecution().executedPlan().toString()
