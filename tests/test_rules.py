import pytest
from pyspark.sql import functions as F

from brevier.functions import dates as D
from brevier.functions import text as T
from brevier.operators import rules as R

PACK = R.fitness_rules()


def check(spark, cases, column):
    """cases: (expected, value, ...); column: a function of the columns v0, v1, ..."""
    width = max(len(c) for c in cases) - 1
    schema = ", ".join(f"v{k} string" for k in range(width))
    rows = [(*c[1:], *[None] * (width - len(c) + 1)) for c in cases]
    got = spark.createDataFrame(rows, schema).coalesce(1).select(column(*[F.col(f"v{k}") for k in range(width)]).alias("x")).collect()
    assert [r.x for r in got] == [c[0] for c in cases]


def test_brands(spark):
    cases = [
        ("Bowflex", "Bowflex and Schwinn treadmill"), (None, "Matrix film review"), ("SHUA", "舒華SHUA體育"),
        ("Cybex", "the treadmill by Cybex"), (None, "Cybex stroller"), ("Sole", "sole F63"), ("TRUE Fitness", "A manufacturer, True Fitness"),
    ]
    check(spark, cases, lambda t: R.detect_brand(PACK, t))


def test_classes(spark):
    cases = [
        ("finance", "Peloton stock jumps", "Peloton"), ("brand", "Horizon treadmill review", "Horizon"), ("tech", "New training plan", None),
        ("market", "Global demand outlook", None), ("competitor", "A new bike", "Peloton"), ("tech", "A smart thing", ""),
    ]
    check(spark, cases, lambda t, b: R.classify(PACK, t, F.lit(""), b))
    products = [("cardio", "Treadmill and dumbbell set"), ("wearable", "Garmin smartwatch"), ("other", "Nutrition template"), ("strength", "啞鈴"), ("other", None)]
    check(spark, products, lambda t: R.classify_product(PACK, t, F.lit(None).cast("string")))
    check(spark, [("other", None), ("other", "odd"), ("cardio", "cardio")], lambda p: R.effective_product(PACK, p))


def test_exclusion(spark):
    cases = [
        ("off_topic", "Oura smart ring update", None, ""), ("cross_industry_noise", "Baby stroller sale", None, ""), ("no_relevance", "Weather today", None, None),
        ("marketplace_spam", "x", None, " eBay Motors"), ("cross_industry_noise", "Tonal shift in decor", "Tonal", ""), (None, "Peloton breakaway by a rider", "Peloton", ""),
        ("celebrity_noise", "葉舒華 跑步機", "SHUA", ""), ("brand_ambiguous_no_context", "舒華 news", "SHUA", ""), (None, "舒華體育 news", "SHUA", ""),
        ("apparel_noise", "Peloton leggings", "Peloton", ""), (None, "Peloton bike leggings", "Peloton", ""), (None, "gym news", "", ""),
        ("marketplace_spam", "treadmill replacement part", None, ""),
    ]
    check(spark, cases, lambda t, b, s: R.exclusion_reason(PACK, t, F.lit(""), b, s))
    check(spark, [(None, "Weather today", None)], lambda t, b: R.exclusion_reason(PACK, t, F.lit(""), b, F.lit("x"), True))
    loud = R.fitness_rules(with_breakaway=True)
    check(spark, [(True, "breakaway in the peloton"), (False, "Precor Breakaway treadmill")], lambda t: R.is_noise(loud, t))


def test_apparel_and_official(spark):
    check(spark, [(True, "Team jersey launch"), (False, "New Jersey gym"), (False, "Jersey City club"), (False, "Running shoes and treadmill")], lambda t: R.is_apparel(PACK, t))
    check(spark, [(True, "Peloton launches new bike"), (False, "How to launch a workout"), (False, "What is new"), (False, None)], lambda t: R.is_official_news(PACK, t))
    check(spark, [(True, "View All"), (True, "short one"), (False, "A headline that is long enough"), (True, None)], lambda t: R.is_category_title(PACK, t))
    check(spark, [(True, "/stories/abc"), (False, "/products/x"), (False, "/stories/"), (True, "/en/news/xyz/"), (False, "/en/news/x")], lambda t: R.is_article_path(PACK, F.lit("/stories/"), t))


def test_dates(spark):
    cases = [
        ("2026-07-05", "July 5, 2026"), ("2026-07-05", "5 Jul 2026"), ("2026-07-05", "7/5/2026"), ("2026-02-31", "2026-02-31"), (None, "2026-13-01"),
        (None, "2036-01-01"), (None, "2026-09-01"), (None, "1999-12-31, July 5, 2026"), ("2026-07-05", "2026-07-05T23:30:00-08:00"), (None, ""), (None, "junk"), (None, None),
    ]
    check(spark, cases, lambda t: D.normalise_date(t, "2026-08-01"))
    mails = [("2026-07-06", "Mon, 06 Jul 2026 02:18:00 EST"), ("2026-07-06", "Sun, 05 Jul 2026 22:18:00 -0500"), ("2026-07-05", "05 Jul 2026 10:00 GMT"), ("2026-07-05", "5 Jul 2026 10:00:00"), (None, "bad"), (None, None)]
    check(spark, mails, D.mail_date)
    check(spark, [(True, "2026-07-26"), (False, "2026-07-25"), (False, "2026-08-02"), (False, "x"), (False, None)], lambda t: D.is_within_days(t, "2026-08-01", 7))
    assert D.cutoff("2026-08-01") == "2024-07-22"


def test_text(spark):
    check(spark, [("https://x.com/a", "https://X.com/A/?utm=1"), ("https://x.com/a#top", "https://x.com/a#top"), (None, None)], T.url_key)
    check(spark, [("pelotons newbike", "Peloton’s  New-Bike!"), ("", "!?"), ("舒華 體育", " 舒華　體育 ")], T.title_key)
    check(spark, [("A - B|C", "A - B - C"), ("A -|Unknown", "A - "), ("x|Unknown", "x")], lambda t: F.concat_ws("|", T.title_and_source(t)["title"], T.title_and_source(t)["source"]))
    check(spark, [("%22a%20b%22%20%C3%A9/x%2A~", '"a b" é/x*~')], T.percent_encode)
    check(spark, [("a & b c", "<p>a &amp; b</p>&lt;b&gt;c<script>x</script>"), ("", None), ("", "")], T.clean_html)
    check(spark, [("&amp;lt;&lt;&quot;'", "&lt;<\"'"), ("", None)], T.escape_html)
    check(spark, [("ABC1", "ＡＢＣ①"), (None, None)], T.nfkc)
    check(spark, [("b", "", "b"), ("a", "a", "b"), ("b", None, "b")], T.either)
    check(spark, [("2026-01-02 03:04", "2026-01-02T03:04:05"), ("odd", "odd")], T.display_time)
    check(spark, [(True, "x 官方"), (False, "x"), (False, None)], T.is_official_source)


@pytest.mark.parametrize(("keyword", "hit", "miss"), [("ai", "an AI coach", "training"), ("10-k", "the 10-K filed", "10k"), ("健身", "大健身房", "健 身")])
def test_keywords(spark, keyword, hit, miss):
    check(spark, [(True, hit), (False, miss)], lambda t: T.has_keyword(t, [keyword]))
