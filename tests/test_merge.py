import random

from pyspark.sql import functions as F

from brevier.operators import rules as R
from brevier.operators.dedupe import greedy_distinct, not_in_inventory, outcomes
from brevier.operators.merge import ARTICLE, clean_actions, cleaning_report, keyed, run_pipeline, running_number
from brevier.sources.feeds import RAW

PACK = R.fitness_rules()
RUN = "2026-08-01"
KEYS = "seq long, url_key string, title_key string, reason string"


def sequential(rows, urls=(), titles=()):
    """What a pass over rows (seq, url, title, reason) makes of each."""
    known_u, known_t, out = set(), set(), {}
    for seq, u, t, reason in rows:
        if u in urls or t in titles:
            out[seq] = "dup_existing"
        elif u in known_u or t in known_t:
            out[seq] = "dup_within"
        elif reason:
            out[seq] = reason
        else:
            out[seq] = "accepted"
            known_u.add(u)
            known_t.add(t)
    return out


def test_greedy_equals_sequential(spark):
    rng = random.Random(1)
    for n, keys in ((300, 80), (120, 4)):
        rows = [(k, f"u{rng.randrange(keys)}", f"t{rng.randrange(keys)}", "x" if rng.random() < 0.1 else None) for k in range(n)]
        df = spark.createDataFrame(rows, KEYS).withColumn("ok", F.col("reason").isNull())
        got = {r.seq for r in greedy_distinct(df, eligible="ok").where("accepted").collect()}
        assert got == {k for k, v in sequential(rows).items() if v == "accepted"}
        stock = spark.createDataFrame([("u1", "zz"), ("", ""), ("q", "t2")], "url_key string, title_key string")
        judged = {r.seq: r.outcome for r in outcomes(df.drop("ok"), stock).collect()}
        assert judged == sequential(rows, {"u1", "q"}, {"zz", "t2"})


def test_known_chains(spark):
    for rows, accepted in (
        ([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t2")], {1, 3}),
        ([(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t3")], {1, 3}),
        ([(k, f"u{k // 2}", f"t{(k + 1) // 2}") for k in range(20)], set(range(0, 20, 2))),
        ([], set()),
    ):
        df = spark.createDataFrame(rows, "seq long, url_key string, title_key string")
        assert {r.seq for r in greedy_distinct(df).where("accepted").collect()} == accepted


def test_anti_join_ignores_empty_keys(spark):
    new = spark.createDataFrame([(1, "", "a"), (2, "x", "b"), (3, "y", "c")], "seq long, url_key string, title_key string")
    old = spark.createDataFrame([("", "q"), ("x", None), (None, "c")], "url_key string, title_key string")
    assert [r.seq for r in not_in_inventory(new, old).collect()] == [1]


def test_running_number(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "seq")
    got = sorted((r.seq, r.n) for r in running_number(df, "seq", "n", per_bucket=50).collect())
    assert [n for _, n in got] == list(range(1, len(got) + 1))
    assert running_number(df.limit(0), "seq", "n").count() == 0


def article(k, title, **other):
    row = {"id": k, "title": title, "url": f"https://a.com/{k}", "source": "S", "date": "2026-07-01", "category": "market", "categoryName": "c", "brand": None, "summary": title, "source_type": "google_news", "first_seen": "2026-07-01", "product_category": "other"}
    return tuple((row | other).values())


def test_pipeline_is_idempotent_and_keeps_ids(spark):
    existing = spark.createDataFrame([article(7, "Old treadmill news"), article(3, "舒華 葉舒華 news", brand="SHUA")], ARTICLE)
    item = lambda seq, title, link, **o: tuple(({"seq": seq, "raw_title": title, "link": link, "summary": None, "date": "2026-07-20", "date_is_real": True, "source_type": "google_news", "brand": None, "source": None} | o).values())
    raw = spark.createDataFrame(
        [
            item(1, " Old treadmill news - Paper", "https://b.com/1"), item(2, "New gym opens - Paper", "https://b.com/2?x=1"), item(3, "New gym opens! - Other", "https://b.com/3"),
            item(4, "Weather - Paper", "https://b.com/4"), item(5, "Old gym - Paper", "https://b.com/5", date="2020-01-01"), item(6, "", "https://b.com/6"),
            item(7, "How to row", "https://b.com/7", source_type="official", source="X 官方"), item(8, "Peloton launches a bike", "https://b.com/8", source_type="official", source="X 官方", date_is_real=False),
            item(9, "Peloton unveils a bike", "https://b.com/9", source_type="official", source="X 官方"),
        ],
        RAW,
    )
    out = run_pipeline(existing, raw, PACK, RUN)
    rows = {r.id: r for r in out["articles"].collect()}
    assert sorted(rows) == [7, 8, 9]
    assert (rows[8].title, rows[8].source, rows[8].first_seen) == ("New gym opens", "Paper", RUN) and rows[9].brand == "Peloton"
    assert {r.outcome: r.n for r in out["report"].collect()} == {
        "dup_existing": 1, "accepted": 2, "dup_within": 1, "no_relevance": 1, "too_old": 1, "official_not_news": 1, "official_no_real_date": 1,
    }
    assert out["cleaned"].first().removed_celebrity_noise == 1
    again = run_pipeline(out["articles"], raw, PACK, RUN)
    assert again["added"].count() == 0 and again["articles"].count() == 3


def test_cleaning(spark):
    rows = [
        article(1, "How to row", source_type="official"), article(2, "Peloton launches a bike", source_type="official", date=RUN), article(3, "Peloton launches a row", source_type="official", date=RUN),
        article(4, "Air Jordan sneaker news", source_type="product"), article(5, "gym Air Jordan news", source_type="product"), article(6, "Plain news"), article(7, "Peloton wins an award", source_type="product", source="P 官方"),
    ]
    found = spark.createDataFrame([("https://a.com/2", "2026-06-01")], "url string, real_date string")
    actions = clean_actions(spark.createDataFrame(rows, ARTICLE), PACK, RUN, found)
    assert {r.id: r.action for r in actions.collect()} == {
        1: "removed_howto", 2: "date_corrected", 3: "removed_no_real_date", 4: "removed_offtopic", 5: "product_to_gnews", 6: "keep", 7: "keep",
    }
    report = cleaning_report(actions).first()
    assert (report.removed_total, report.date_corrected, report.product_to_gnews, len(report.samples)) == (3, 1, 1, 5)
    assert {r.id: (r.date, r.source_type) for r in actions.where("id in (2, 7)").collect()} == {2: ("2026-06-01", "official"), 7: ("2026-07-01", "official")}


def test_keys(spark):
    row = keyed(spark.createDataFrame([article(1, "A  B!")], ARTICLE)).first()
    assert (row.url_key, row.title_key) == ("https://a.com/1", "a b")


def test_last_id_counts_rows_that_are_cleaned_away(spark):
    existing = spark.createDataFrame([article(1, "Peloton news"), article(9, "How to row", source_type="official")], ARTICLE)
    raw = spark.createDataFrame([(1, "Peloton news", "https://a.com/1", "", RUN, True, "google_news", None, None)], RAW)
    out = run_pipeline(existing, raw, PACK, RUN)
    assert [r.id for r in out["articles"].collect()] == [1] and out["added"].count() == 0
    assert out["last_id"].first().last_id == 9


def test_contents_are_judged_of_unknown_rows_alone(spark):
    """Rows that the inventory has are not judged; the others get what the judge says."""
    rows = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t2"), (3, "u3", "t3")], "seq long, url_key string, title_key string")
    seen = []

    def judge(new):
        seen.extend(r.seq for r in new.collect())
        return new.withColumn("reason", F.when(F.col("seq") == 3, "off_topic"))

    found = outcomes(rows, rows.where("seq = 1"), judge=judge).collect()
    assert sorted(seen) == [2, 3]
    assert {r.seq: r.outcome for r in found} == {1: "dup_existing", 2: "accepted", 3: "off_topic"}
