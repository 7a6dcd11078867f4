import json
from concurrent.futures import ThreadPoolExecutor
from http import client

import pytest
from pyspark.sql import functions as F

from brevier.operators import html as H
from brevier.operators import rules as R
from brevier.operators.tokens import parse_users, sign_token, verify_token
from brevier.sources import corpus, feeds, http
from brevier.streaming import ratelimit, sse
from brevier.streaming.daily import run_daily, run_landed

PACK = R.fitness_rules()


def test_catalog(spark):
    rows = feeds.feed_catalog(spark).orderBy("seq").collect()
    assert len(rows) == 286 and len({(r.url, r.source_type) for r in rows}) == 286
    assert rows[0].url.startswith("https://news.google.com/rss/search?q=%22Life%20Fitness%22%20when%3A1y&hl=en-US")
    assert rows[-1].source == "Athletech News"
    assert feeds.story_sources(spark).count() == 33


def test_landed_feeds(spark):
    body = "<rss><channel><item><title> A gym - P </title><link>http://a/1</link><description>&lt;b&gt;x&lt;/b&gt; y</description><pubDate>Sun, 05 Jul 2026 10:00:00 GMT</pubDate></item><item><title></title><link>l</link></item></channel></rss>"
    landed = spark.createDataFrame([("u1", body, "google_news", None, None)], "url string, body string, source_type string, brand string, source string")
    raw = feeds.raw_items(feeds.entries_of(landed), "2026-08-01", "ord").collect()
    assert [(r.raw_title, r.link, r.summary, r.date, r.date_is_real) for r in raw] == [("A gym - P", "http://a/1", "x y", "2026-07-05", True)]
    status = {r.url: r.ok for r in feeds.feed_status(spark.createDataFrame([("u1",), ("u2",)], "url string"), landed).collect()}
    assert status == {"u1": True, "u2": False}


def test_first_source(spark):
    items = spark.createDataFrame([("a", 1, "page", "x"), ("a", 2, "page", "y"), ("b", 0, "feed", "z")], "brand string, priority int, kind string, link string")
    brands = spark.createDataFrame([("a",), ("b",), ("c",)], "brand string")
    got = {(r.brand, r.kind, r.link) for r in feeds.first_source(items, brands).collect()}
    assert got == {("a", "page", "x"), ("b", "feed", "z"), ("c", "none", None)}


def test_fetch(spark):
    calls, naps = [], []

    def ask(answers):
        def one(url, policy):
            calls.append(url)
            got = answers[min(len(calls) - 1, len(answers) - 1)]
            if isinstance(got, Exception):
                raise got
            return got

        return one

    assert http.fetch("u", http.SLOW, ask([(500, ""), OSError("x"), (200, "ok")]), naps.append) == "ok" and len(calls) == 3
    assert 1 <= naps[0] < 2 and 2 <= naps[1] < 3
    for answers, n in (([(404, "")], 1), ([(503, "")], 3)):
        calls.clear()
        assert http.fetch("u", http.SLOW, ask(answers), naps.append) is None and len(calls) == n
    calls.clear()
    assert http.fetch("u", http.FAST, ask([(503, "")]), naps.append) is None and len(calls) == 1

    class Fake(http.FetchSource):
        ask = staticmethod(lambda url, policy: (200, "body of " + url) if "good" in url else (404, ""))

        @classmethod
        def name(cls):
            return "fake"

    spark.dataSource.register(Fake)
    urls = spark.createDataFrame([("good1",), ("bad",)], "url string")
    got = http.fetched(urls, http.FAST, lambda url, policy: (200, "body of " + url) if "good" in url else (404, "")).collect()
    assert {(r.url, r.ok, r.body) for r in got} == {("good1", True, "body of good1"), ("bad", False, None)}
    rows = spark.read.format("fake").option("urls", "good1\nbad\ngood2").option("perTask", 1).load().collect()
    assert {(r.url, r.ok, r.body) for r in rows} == {("good1", True, "body of good1"), ("bad", False, None), ("good2", True, "body of good2")}


def test_corpus(spark, tmp_path):
    doc = {"generated_at": "now", "articles": [{"id": 2, "title": "T", "url": "u", "date": "2026-01-01"}, {"title": "treadmill"}], "stats": {"total": 2}}
    path = tmp_path / "news.json"
    path.write_text(json.dumps(doc))
    found = corpus.articles_of(corpus.read_document(spark, str(path)), PACK, "2026-08-01").collect()
    assert [(r.id, r.source, r.date, r.first_seen, r.product_category) for r in found] == [(2, "Unknown", "2026-01-01", "2026-01-01", "other"), (None, "Unknown", "2026-08-01", "2026-08-01", "cardio")]
    path.write_text("{broken")
    assert corpus.read_document(spark, str(path), on_error="empty").count() == 0
    table = str(tmp_path / "table")
    assert corpus.read_table(spark, table).count() == 0
    rows = spark.createDataFrame([tuple(found[0])], corpus.ARTICLE)
    corpus.replace_table(rows, table)
    corpus.replace_table(corpus.read_table(spark, table).union(rows), table)
    assert corpus.read_table(spark, table).count() == 2
    out = corpus.output_document(rows, spark.createDataFrame([(1,)], "total long"), "now", ["a"], [])
    corpus.write_document(out, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["articles"][0]["brand"] is None
    corpus.write_articles(rows, str(tmp_path / "lines"))
    assert spark.read.schema(corpus.ARTICLE).json(str(tmp_path / "lines")).first().title == "T"
    lock = str(tmp_path / "lock")
    first = corpus.take_lock(spark, lock, 0)
    assert first and not corpus.take_lock(spark, lock, 0)
    second = corpus.take_lock(spark, lock, 1 << 60)
    assert second and not corpus.release_lock(spark, lock, first)  # it is another's by now
    assert corpus.release_lock(spark, lock, second) and not corpus.release_lock(spark, lock, second)
    corpus.append_run(spark, str(tmp_path / "log"), "d", 1, 2, ["f"] * 60)
    assert len(spark.read.parquet(str(tmp_path / "log")).first().failed) == 50


def test_replacement_survives_a_crash(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    row = lambda k: spark.createDataFrame([(k, *["x"] * 11)], corpus.ARTICLE)
    ids = lambda: [r.id for r in corpus.read_table(spark, table).collect()]

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(corpus, "commit_version", dies)
        with pytest.raises(RuntimeError):
            corpus.replace_table(row(1), table)
    assert ids() == []  # nothing was ever in force
    corpus.replace_table(row(2), table)
    opened = corpus.read_table(spark, table)
    with monkeypatch.context() as m:
        m.setattr(corpus, "commit_version", dies)
        with pytest.raises(RuntimeError):
            corpus.replace_table(row(3), table)
    assert ids() == [2]
    corpus.replace_table(row(4), table)
    assert ids() == [4] and [r.id for r in opened.collect()] == [2]  # a reader of the version before goes on
    corpus.replace_table(row(5), table)
    assert ids() == [5] and len(corpus.versions(spark, table)) == 2
    for f in (tmp_path / "table" / "_versions").iterdir():
        f.unlink()
    with pytest.raises(OSError, match="lost"):
        corpus.read_table(spark, table)


def article(spark, *ids):
    return spark.createDataFrame([(k, *["x"] * 11) for k in ids], corpus.ARTICLE)


def test_two_writers_lose_no_row(spark, tmp_path):
    """Two jobs start from one version; the slower one does its work again on what the faster one left."""
    table, asked = str(tmp_path / "table"), []
    corpus.replace_table(article(spark, 1), table)

    def slow(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        if len(asked) == 1:
            corpus.update_table(spark, table, lambda own: own.union(article(spark, 2)))
        return rows.union(article(spark, 3))

    assert corpus.update_table(spark, table, slow) == 2
    assert asked == [[1], [1, 2]] and sorted(r.id for r in corpus.read_table(spark, table).collect()) == [1, 2, 3]
    assert [n for n, _ in corpus.versions(spark, table)] == [1, 2]
    assert len([f for f in (tmp_path / "table").iterdir() if f.name.startswith("data-")]) == 2  # the loser's rows are gone

    def never(rows):
        corpus.update_table(spark, table, lambda own: own)
        return rows

    with pytest.raises(corpus.Conflict):
        corpus.update_table(spark, table, never, tries=3)
    with pytest.raises(corpus.Conflict):  # a job that slept over many versions can't make an old one again
        corpus.write_version(article(spark, 9), table, 1, {}, 2)


def test_many_writers_at_once(spark, tmp_path):
    table = str(tmp_path / "table")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: corpus.update_table(spark, table, lambda own: own.union(article(spark, k)), tries=50), range(6)))
    assert sorted(r.id for r in corpus.read_table(spark, table).collect()) == [*range(6)]
    assert corpus.numbers(spark, f"{table}/_versions") == [*range(6)]


def test_a_batch_counts_once(spark, tmp_path):
    table = str(tmp_path / "table")
    add = lambda k: lambda own: own.union(article(spark, k))
    assert corpus.update_table(spark, table, add(1), ("a", 0)) == 0
    assert corpus.update_table(spark, table, add(1), ("a", 0)) is None
    assert corpus.update_table(spark, table, add(2), ("b", 0)) == 1
    assert corpus.update_table(spark, table, add(3)) == 2
    assert corpus.update_table(spark, table, add(1), ("a", 0)) is None and corpus.update_table(spark, table, add(4), ("a", 1)) == 3
    assert sorted(r.id for r in corpus.read_table(spark, table).collect()) == [1, 2, 3, 4]


def test_stale_lock_falls_to_one(spark, tmp_path, monkeypatch):
    """Of two jobs that both found the lock stale one gets it, in whatever order they go on."""
    lock, hour = str(tmp_path / "lock"), 3_600_000
    assert corpus.take_lock(spark, lock, 0)
    own, tokens = corpus.create_once, []

    def late(spark, path, text):
        if not tokens:  # another job is faster between the look and the step
            tokens.append(None)
            monkeypatch.setattr(corpus, "create_once", own)
            tokens[0] = corpus.take_lock(spark, lock, 3 * hour)
        return own(spark, path, text)

    monkeypatch.setattr(corpus, "create_once", late)
    assert corpus.take_lock(spark, lock, 3 * hour) is None and tokens[0]
    assert corpus.take_lock(spark, lock, 4 * hour) is None and corpus.release_lock(spark, lock, tokens[0])
    with ThreadPoolExecutor(8) as pool:
        got = [t for t in pool.map(lambda _: corpus.take_lock(spark, lock, 4 * hour), range(8)) if t]
    assert len(got) == 1 and corpus.release_lock(spark, lock, got[0])


def test_create_once(spark, tmp_path):
    path = str(tmp_path / "deep" / "file")
    assert corpus.create_once(spark, path, "é one") and not corpus.create_once(spark, path, "two")
    assert corpus.read_small(spark, path) == "é one" and [f.name for f in (tmp_path / "deep").iterdir()] == ["file"]


def test_output_document(spark):
    rows = spark.createDataFrame([(1, *["x"] * 11)], corpus.ARTICLE)
    stats = spark.createDataFrame([(1,)], "total long")
    cleaned = spark.createDataFrame([tuple(range(8))], ", ".join(f"{c} long" for c in corpus.CLEANED))
    doc = corpus.output_document(rows, stats, "now", ["a"], [], {"Peloton": ("feed", "u")}, cleaned).first()
    assert doc.official_results == {"Peloton": ["feed", "u"]} and doc.cleaned_noise["removed_total"] == 7
    assert corpus.output_document(rows, stats, "now", [], []).first().cleaned_noise is None
    with pytest.raises(ValueError, match="write_articles"):
        corpus.output_document(rows, stats, "now", [], [], most=0)


def test_source_lists(spark):
    found = spark.createDataFrame([(2, "u2", True), (1, "u1", True), (3, "u3", False)], "seq int, url string, ok boolean")
    stories = spark.createDataFrame([(0, "A", False, None), (1, "B", True, "https://b")], "ord int, brand string, ok boolean, url string")
    got = feeds.source_lists(found, stories).first()
    assert got.sources_ok == ["u1", "u2", "official:B:https://b"] and got.sources_failed == ["u3", "official:A"]


def test_connect_and_read_times(monkeypatch):
    seen = []

    class Socket:
        def settimeout(self, seconds):
            seen.append(seconds)

        def close(self):
            pass

    def send(self, data):
        self.connect()
        seen.append(data)
        raise OSError("enough")

    monkeypatch.setattr(client.HTTPConnection, "connect", lambda self: seen.append(self.timeout) or setattr(self, "sock", Socket()))
    monkeypatch.setattr(client.HTTPConnection, "send", send)
    assert http.fetch("http://x.invalid/", http.FAST) is None
    assert seen[:2] == [5, 8] and b"Accept: text/html" in seen[2]


def test_html(spark):
    listing = """<nav><a href='/stories/no'>Launches a navigation text that is long</a></nav><p><b>hi
      <a href='/stories/abc?x=1'>Brand launches a brand new treadmill today</a><a href='mailto:a'>mail</a>
      <a href='/stories/abc'>Brand launches a brand new treadmill again</a><a href='https://other.org/stories/q'>Brand launches a foreign thing here</a>"""
    pages = spark.createDataFrame([("https://www.x.com/stories/", listing), (None, None)], "url string, html string")
    assert [(r.ord, r.href) for r in H.article_links(pages, PACK).collect()] == [(0, "https://www.x.com/stories/abc?x=1")]
    bodies = [
        ("2026-07-01", '<meta name="date" content="nope"><script type="application/ld+json">[{"a":{"datePublished":"2026-07-01"}}]</script>'), ("2026-07-05", "<time>5 Jul 2026</time>"),
        ("2026-07-02", "<div class='update'>July 2, 2026</div>"), (None, "<p>x"), ("2026-07-03", "<meta property='og:updated_time' content='2026-07-03T1'>"), (None, None),
    ]
    got = H.published_dates(spark.createDataFrame(bodies, "wanted string, html string"), "2026-08-01").collect()
    assert all(r.real_date == r.wanted for r in got)


def test_event_streams(spark):
    lines = [
        ("s", 0, 'data: {"delta":"he","model":"m"}'), ("s", 1, "junk"), ("s", 2, 'data: {"delta":"y"}'), ("s", 3, "data: {bad"), ("s", 4, 'data: {"done":true,"text":""}'), ("s", 5, 'data: {"delta":"late"}'),
        ("e", 0, 'data: {"error":"boom"}'), ("n", 0, 'data: {"delta":"z"}'), ("d", 0, 'data: {"done":true,"text":"whole"}'),
    ]
    got = {r.stream_id: r for r in sse.fold(spark.createDataFrame(lines, "stream_id string, ord long, line string")).collect()}
    assert (got["s"].text, got["s"].model, got["s"].is_done) == ("hey", "m", True)
    assert got["e"].error == "boom" and got["n"].text == "z" and got["d"].text == "whole"
    assert sse.parsed_objects('[{"a":"}"},{"b":{"c":1}}') == ['{"a":"}"}', '{"b":{"c":1}}']
    assert sse.parsed_objects('data: {"a":1}\ndata: [DONE]\ndata: {"b":2}') == ['{"a":1}']
    chunk = spark.createDataFrame([("abcde",), ("",), (None,)], "t string").select(sse.chunks("t").alias("c")).collect()
    assert [r.c for r in chunk] == [["ab", "cd", "e"], [], []]
    sent = spark.range(1).select(sse.encode_end(F.lit("t"), F.lit("m")).alias("x")).first().x
    frames = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "tick int, ord long, text string")
    assert {r.tick: r.text for r in sse.latest_frame(frames, "tick").collect()} == {1: "b", 2: "c"}
    assert sent == 'data: {"done":true,"text":"t","model":"m"}\n\n'


def test_streaming_fold_and_limits(spark, tmp_path):
    source = str(tmp_path / "lines")
    spark.createDataFrame([("s", 0, 'data: {"delta":"he"}'), ("s", 1, 'data: {"done":true}')], "stream_id string, ord long, line string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("stream_id string, ord long, line string").parquet(source)
    q = sse.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.text, r.ended) for r in spark.table("folded").collect()] == [("he", True)]
    times = [k * 1000 for k in range(12)] + [700_000]
    attempts = spark.createDataFrame([("a", t) for t in times] + [("b", 5), (None, 1)], "ip string, ts_ms long")
    wanted = [False] * 10 + [True, True, False]
    assert [r.limited for r in ratelimit.limited(attempts).where("ip = 'a'").orderBy("ts_ms").collect()] == wanted
    place = str(tmp_path / "attempts")
    attempts.where("ip = 'a'").coalesce(1).write.parquet(place)
    stream = spark.readStream.schema("ip string, ts_ms long").parquet(place)
    q = ratelimit.limited_stream(stream).writeStream.outputMode("append").format("memory").queryName("limits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.limited for r in spark.table("limits").orderBy("ts_ms").collect()] == wanted


def test_daily_job(spark, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "inventory")
    row = (1, "New gym opens - Paper", "https://b.com/2", None, "2026-07-20", True, "google_news", None, None)
    spark.createDataFrame([row], feeds.RAW).write.parquet(landed)
    row2 = (1, "Another gym opens - Paper", "https://b.com/3", None, "2026-07-20", True, "google_news", None, None)
    for _ in range(2):
        run_landed(spark, landed, feeds.RAW, table, str(tmp_path / "progress"), PACK, lambda: "2026-08-01").awaitTermination(180)
    assert [(r.id, r.title) for r in corpus.read_table(spark, table).collect()] == [(1, "New gym opens")]
    spark.createDataFrame([row2], feeds.RAW).write.mode("append").parquet(landed)
    where = (spark, landed, feeds.RAW, table, str(tmp_path / "progress"), PACK, lambda: "2026-08-01")
    lock = corpus.take_lock(spark, f"{table}/_lock", 1000)
    assert not run_daily(*where, clock=lambda: 2) and corpus.read_table(spark, table).count() == 1
    assert corpus.release_lock(spark, f"{table}/_lock", lock) and run_daily(*where, clock=lambda: 3)
    assert sorted((r.id, r.title) for r in corpus.read_table(spark, table).collect()) == [(1, "New gym opens"), (2, "Another gym opens")]
    assert run_daily(*where) and corpus.numbers(spark, f"{table}/_versions") == [0, 1]


def test_tokens(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    token = one(sign_token(F.lit('{"u":"a>?","exp":100}'), "s"))
    assert token.count(".") == 1 and "=" not in token
    assert one(verify_token(F.lit(token), "s", 50)) == '{"u":"a>?","exp":100}'
    for text, secret, now in ((token, "s", 101), (token, "bad", 50), (token + "x", "s", 50), ("a.b.c", "s", 1), ("", "s", 1)):
        assert one(verify_token(F.lit(text), secret, now)) is None
    users = one(parse_users(F.lit("a:b, c:d:e,x:,y")))
    assert [(u.name, u.password) for u in users] == [("a", "b"), ("c", "d:e")]


def test_output_documents(spark, tmp_path):
    """More articles than one document may hold: several, which are read back as one corpus in the order of one document."""
    dates = ["2026-01-02", None, "2026-01-05", "2026-01-02", "2026-01-03"]
    rows = spark.createDataFrame([(k, *["x"] * 3, d, *["x"] * 7) for k, d in enumerate(dates)], corpus.ARTICLE)
    stats = spark.createDataFrame([(5,)], "total long")
    docs = corpus.output_documents(rows, stats, "now", ["a"], [], per_document=2)
    corpus.write_document(docs, str(tmp_path / "docs"))
    read = spark.read.schema(corpus.PART).json(str(tmp_path / "docs"))
    assert sorted((r.first, len(r.articles), r.stats.total, r.sources_ok) for r in read.collect()) == [(0, 2, 5, ["a"]), (2, 2, 5, ["a"]), (4, 1, 5, ["a"])]
    places = {r.id: r.pos for r in corpus.places_of(read).collect()}
    one = corpus.output_document(rows, stats, "now", ["a"], []).first()
    assert [a.id for a in one.articles] == sorted(places, key=places.get) == [2, 4, 0, 3, 1]
    assert corpus.articles_of(read, PACK, "2026-08-01").count() == 5
    none = corpus.output_documents(rows.limit(0), stats, "now", ["a"], []).collect()
    assert [(r.first, r.articles) for r in none] == [(0, [])]


def test_chunks_in_one_pass(spark):
    """Pieces of long texts, line ends and characters of two units among them, by one pass and not by seeking each."""
    texts = [None, "", "a", "\n\U0001f600", "é\n\U0001f600健" * 777, "x" * 100_001]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", sse.chunks("t").alias("c"))
    for r in rows.collect():
        text = texts[r.id] or ""
        size = max(2, -(-len(text) // 120))
        assert r.c == [text[k : k + size] for k in range(0, len(text), size)]
    assert "substring" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_many_pages_leave_in_parts(spark, monkeypatch):
    """Links of more pages than a worker holds at once, null pages and kept columns among them."""
    pages = [(k, f"https://a.com/{k}", None if k % 7 == 0 else "<a href='/x'>one</a>" * (k % 4), [k]) for k in range(300)]
    monkeypatch.setattr(H, "PAGES_AT_ONCE", 16)
    found = H.links(spark.createDataFrame(pages, "id long, url string, html string, more array<long>").coalesce(1), drop_nav=False)
    wanted = [(k, k, j, "one", "https://a.com/x") for k in range(300) if k % 7 for j in range(k % 4)]
    assert sorted((r.id, r.more[0], r.ord, r.text, r.href) for r in found.collect()) == wanted
