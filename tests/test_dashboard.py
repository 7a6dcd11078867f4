import pytest
from pyspark.sql import functions as F

from brevier.operators import dashboard as B
from brevier.operators import prompts as P
from brevier.operators import rules as R
from brevier.operators import stats as S

ROWS = [
    (1, "2026-07-05", "competitor", "Peloton", "A", "cardio", "Bike foo"), (2, "2026-07-05", "tech", None, "B", None, "bar Ring"), (3, "2026-07-01", "finance", "Peloton", "A", "odd", "Stock"),
    (4, "2026-06-30", "market", "Sole", "C", "strength", "Rack"), (5, "bad", "market", "", "C", "other", "None"),
]
SCHEMA = "id long, date string, category string, brand string, source string, product_category string, title string"


def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_counts(spark):
    got = {r.brand: r.cnt for r in S.zero_filled(rows(spark), "brand", ["Sole", "Tonal"]).collect()}
    assert got == {"Sole": 1, "Tonal": 0, "Peloton": 2}
    doc = S.stats_document(rows(spark).withColumns({"summary": F.lit("x"), "source_type": F.lit("google_news")}), R.fitness_rules(), "now").first()
    assert doc.total == 5 and doc.by_source == {"A": 2, "B": 1, "C": 2} and doc.by_category["brand"] == 0 and len(doc.by_brand) == 28
    assert [t.date for t in doc.timeline] == sorted(t.date for t in doc.timeline)
    empty = S.stats_document(rows(spark).limit(0).withColumns({"summary": F.lit("x"), "source_type": F.lit("g")}), R.fitness_rules(), "now").first()
    assert empty.total == 0 and empty.by_category["tech"] == 0
    assert set(S.fallback_statistics(rows(spark))) == {"category", "brand", "source", "timeline"}


def test_filters(spark):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(B.in_category(rows(spark))) == [1, 2, 4, 5] and ids(B.in_category(rows(spark), "all", True)) == [1, 2, 3, 4, 5]
    assert ids(B.in_category(rows(spark), "finance")) == [3]
    assert ids(B.search(rows(spark), "FOO A", ["title", "source"])) == [1] and len(ids(B.search(rows(spark), "", ["title"]))) == 5
    assert {r.facet: r.cnt for r in B.facets(rows(spark)).collect()} == {"all": 5, "cardio": 1, "strength": 1, "wearable": 0, "other": 3}
    page = B.page(rows(spark), 2, F.desc("date"), "id").collect()
    assert [(r.total, r.shown, r.remaining) for r in page] == [(5, 2, 3)] * 2
    toggled = rows(spark).select(B.toggled(F.array(F.lit(1), F.lit(2)), F.col("id").cast("int")).alias("x")).collect()
    assert toggled[0].x == [2] and toggled[4].x == [1, 2, 5]


def test_rankings(spark):
    found = spark.createDataFrame([("a", 5, 2), ("b", 5, 1), ("c", 0, 3)], "brand string, cnt long, ord long")
    assert [r.brand for r in B.ranked(found, "brand", 2, "ord").collect()] == ["b", "a"]
    assert B.radar(found, "brand", "ord").count() == 0
    share = {r.brand: r.share for r in B.with_share(found, "brand", "ord").collect()}
    assert share == {"a": 50, "b": 50, "c": 0}
    assert {r.brand: r.bar for r in B.with_bar(found).collect()} == {"a": 100, "b": 100, "c": 6}
    k = B.kpis(rows(spark), "date", "source", "2026-07-05").first()
    assert (k.total, k.today, k.week, k.sources) == (5, 2, 4, 3)


def test_heat_grid(spark):
    got = {(r.brand, r.day): (r.cnt, r.intensity) for r in B.heat_grid(rows(spark).where("brand <> ''"), "brand", "date", "id").collect()}
    assert len(got) == 28 and got["Peloton", "2026-07-05"] == (1, 1.0) and got["Sole", "2026-07-05"] == (0, 0.0)


def test_prompts(spark):
    r = rows(spark).withColumns({"categoryName": F.lit(None).cast("string"), "summary": F.col("title")})
    text = P.report_bullets(r, "id", 2).first().bullets
    assert text == "- [2026-07-05] (competitor/Peloton) Bike foo：Bike foo\n- [2026-07-05] (tech/一般) bar Ring：bar Ring"
    assert P.report_bullets(r.limit(0), "id", 2, "none").first().bullets == "none"
    assert '"brand":null' in P.context_json(r, "id", 2).first().context
    body = spark.createDataFrame([('{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}',), ('{"candidates":[]}',), ("x",)], "b string")
    assert [x[0] for x in body.select(P.reply_text("b")).collect()] == ["ab", "", ""]
    assert P.translate(r, "title", str.upper).where("translated = upper(text)").count() == 5
    request = r.select(P.request_body("title", F.lit("be brief")).alias("x")).first().x
    assert '"temperature":0.7' in request and "be brief" in request


def test_busy_services(spark):
    asked, naps = [], []

    def call(value, answers=(429, 503, None)):
        asked.append(value)
        status = answers[min(len(asked) - 1, len(answers) - 1)]
        if status:
            raise P.Busy(status)
        return value.upper()

    assert P.patient(call, sleep=naps.append)("a") == "A" and naps == [0.8, 1.6]
    asked.clear()
    with pytest.raises(P.Busy):
        P.patient(lambda v: call(v, (400,)), sleep=naps.append)("a")
    assert len(asked) == 1

    def first(value):
        if value == "a":
            raise OSError("down")
        return "" if value == "b" else "one " + value

    def second(value):
        if value == "b":
            raise OSError("down")
        return "two " + value

    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("c",)], "t string")
    got = {r.text: r.translated for r in P.translate(rows, "t", first, second).collect()}
    assert got == {"a": "two a", "b": "b", "c": "one c"}


def test_filters(spark):
    rows = spark.createDataFrame([(1, "cardio"), (2, "odd"), (3, None), (4, "other")], "id long, product_category string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(B.with_product(rows, "other")) == [2, 3, 4] and ids(B.with_product(rows, "cardio")) == [1] and len(ids(B.with_product(rows))) == 4
    assert ids(B.lookup(rows, "3")) == [3] and ids(B.lookup(rows, 9)) == []


def test_stored_statistics(spark):
    fresh = spark.createDataFrame([(3, {"a": 1}, ["x"], "now")], "total long, by_brand map<string, long>, timeline array<string>, updated string")
    stored = spark.createDataFrame([(0, {}, [], "")], "total long, by_brand map<string, long>, timeline array<string>, updated string")
    # A number or map counts if it is there, a list or text if it is not empty.
    assert tuple(S.with_stored(fresh, stored).first()) == (0, {}, ["x"], "now")
    assert tuple(S.with_stored(fresh, stored.select("updated")).first()) == (3, {"a": 1}, ["x"], "now")
