"""Cube, deltas, text index and pages, each against the plain way."""

import random
from collections import Counter

from pyspark.sql import functions as F

from brevier.operators import cube as C
from brevier.operators import dashboard as B
from brevier.operators import rules as R
from brevier.operators import stats as S
from brevier.sources import pages, stats_table, text_index

PACK = R.fitness_rules()
CATEGORIES = ["competitor", "tech", "market", "brand", "finance"]


def test_cube_equals_every_filter(spark):
    rng = random.Random(1)
    rows = [(k * k, rng.choice([*CATEGORIES, None]), rng.choice([*B.PRODUCTS, "odd", None]), rng.choice([True, False, None]), "x") for k in range(700)]
    docs = spark.createDataFrame(rows, "id long, category string, product_category string, favourite boolean, bucket string").repartition(3)
    cube = C.facet_cube(docs).cache()
    states = [(c, w, p, f) for c in ["all", *CATEGORIES] for w in (False, True) for p in ["all", *B.PRODUCTS] for f in (False, True)]
    got = {tuple(r)[:4]: r.cnt for r in C.counted(cube, spark.createDataFrame(states, "category string, with_finance boolean, product string, favourites boolean")).collect()}
    for c, w, p, f in states:
        direct = B.with_product(B.in_category(docs.where("favourite") if f else docs, c, w), p)
        if rng.random() < 0.1 or (c, p) == ("all", "all"):
            wanted = sorted(r.id for r in direct.select("id").collect())
            assert sorted(r.id for r in C.ids_in(C.click(cube, c, w, p, f)).collect()) == wanted and got[c, w, p, f] == len(wanted)
    own = lambda c, w, p, f: [k for k, cat, prod, fav, _ in rows if (not f or fav) and (cat == c if c != "all" else w or cat != "finance") and (p == "all" or (prod if prod in B.PRODUCTS else "other") == p)]
    assert got == {s: len(own(*s)) for s in states}
    assert C.facet_cube(docs.limit(0)).count() == 0


def test_ten_days_of_deltas_equal_a_recount(spark, tmp_path):
    rng, path, now = random.Random(2), str(tmp_path / "cells"), {}
    schema = "id long, category string, brand string, source string, source_type string, date string, product_category string, title string, summary string"
    made = lambda k: (k, rng.choice(CATEGORIES), rng.choice(["Peloton", None, "", "Own"]), rng.choice(["a", "b", None]), rng.choice(["official", "rss"]), f"2024-01-0{rng.randrange(1, 9)}", rng.choice(["cardio", "", None, "odd"]), rng.choice(["treadmill", "x"]), None)
    for day in range(10):
        gone = rng.sample(sorted(now), min(len(now), 5))
        moved = rng.sample(sorted(set(now) - set(gone)), min(len(now) - len(gone), 4))
        fresh = [100 * day + k for k in range(20)]
        out = [now[k] for k in gone + moved]
        into = [made(k) for k in moved + fresh]
        frames = [spark.createDataFrame(rows, schema) for rows in (out, into)]
        for _ in range(2 if day in (0, 4) else 1):  # a batch that comes again changes nothing
            stats_table.add_changes(spark, path, *frames, PACK, ("days", day))
        now = {k: v for k, v in now.items() if k not in gone} | {r[0]: r for r in into}
        if day in (0, 4, 9):
            all_rows = spark.createDataFrame([*now.values()], schema)
            kept = stats_table.kept_cells(spark, path)
            wanted = Counter({tuple(r)[:-1]: r.n for r in S.cells(all_rows, PACK).collect()})
            assert Counter({tuple(r)[:-1]: r.n for r in kept.collect()}) == wanted
            assert S.stats_of_cells(kept, PACK, "t").first() == S.stats_document(all_rows, PACK, "t").first()
    frames = spark.createDataFrame([*now.values()], schema), spark.createDataFrame([], schema)
    stats_table.add_changes(spark, path, *frames, PACK)
    assert stats_table.kept_cells(spark, path).count() == 0


def test_text_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(3)
    bits = ["gym", "Fitness ", "健身", "器材", "跑步機", "é", "İstanbul", "\U0001f600", "a", " ", "\n", "10-K", "%_", "ss"]
    rows = [(k, rng.choice([None, "", "x", "健", "".join(rng.choice(bits) for _ in range(rng.randrange(9)))]), rng.choice([None, "src"])) for k in range(300)]
    docs = spark.createDataFrame(rows, "id long, title string, source string").repartition(3)
    path, fields = str(tmp_path / "index"), ["title", "source"]
    text_index.build_text_index(docs, path, "id", fields, per_file=200)
    texts = [" ".join(x for x in (t, s) if x is not None).lower() for _, t, s in rows]
    asked = ["", "a", "健", "健身", "健身器材", "GYM", "gymf", "fitness fitness", "\U0001f600", "s\U0001f600", "k%_", "zzz", "\n", " s", "src", "10-k", "跑步機a"]
    asked += [t[a : a + n] for t in rng.sample([t for t in texts if len(t) > 6], 8) for n in (1, 2, 3, 5) for a in [rng.randrange(len(t) - n)]]
    for query in asked:
        got = sorted(r.id for r in text_index.search_index(docs, path, query, "id", fields).collect())
        assert got == sorted(r.id for r in B.search(docs, query, fields).collect()), query


def test_pages_equal_the_sorted_rows(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "pages")
    rows = [(k, rng.choice([None, *[f"2024-01-{d:02d}" for d in range(1, 20)]]), "x") for k in range(1000)]
    docs = spark.createDataFrame(rows, "id long, date string, title string").repartition(5)
    pages.write_pages(docs, path, per_file=90)
    wanted = [r[0] for r in sorted(sorted(rows), key=lambda r: r[1] or "", reverse=True)]
    assert len(pages.manifest(spark, path)) > 8
    for number in (0, 1, 17, 33, 49, 50):
        got = pages.page_at(spark, path, docs.schema, number, 20).orderBy("place").collect()
        assert [r.id for r in got] == wanted[20 * number : 20 * number + 20] and [r.place for r in got] == [*range(20 * number, min(1000, 20 * number + 20))]
    seen, after = [], None
    date_of = {k: d for k, d, _ in rows}
    for _ in range(12):
        frame = pages.page_after(spark, path, docs.schema, after, 85)
        assert len(frame.inputFiles()) <= 3
        got = [r.id for r in frame.collect()]
        seen += got
        if not got:
            break
        after = (date_of[got[-1]], got[-1])
    assert seen == wanted
    pages.write_pages(docs.limit(0), path)
    assert pages.page_at(spark, path, docs.schema, 0).count() == 0 and pages.page_after(spark, path, docs.schema, None).count() == 0


def test_pages_are_written_by_few_tasks(spark, tmp_path, monkeypatch):
    """Many files come from few tasks, none is over its number of rows, and a page asks the manifest for its own files alone."""
    path, cores = str(tmp_path / "pages"), spark.sparkContext.defaultParallelism
    docs = spark.range(3000).selectExpr("id", "concat('2024-01-', lpad(id % 28 + 1, 2, '0')) AS date")
    pages.write_pages(docs, path, per_file=10)
    files = pages.manifest(spark, path)
    assert len(files) >= 300 and max(f["n"] for f in files) <= 10
    writers = {f["file"].split("/part-")[1].split("-")[0] for f in files}
    assert len(writers) <= max(cores, 3)
    monkeypatch.setattr(pages, "manifest", None)
    wanted = [r.id for r in docs.orderBy(F.desc("date"), "id").collect()]
    assert [r.id for r in pages.page_at(spark, path, docs.schema, 70, 20).orderBy("place").collect()] == wanted[1400:1420]
    last = docs.where(F.col("id") == wanted[1419]).first()
    assert [r.id for r in pages.page_after(spark, path, docs.schema, (last["date"], last["id"]), 20).collect()] == wanted[1420:1440]


def test_postings_are_lists_of_blocks(spark, tmp_path):
    """A gram has one row for a block of texts, not one for each text; repeated ids don't hide a row from a search."""
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(k % 90, f"gym row {k % 90}") for k in range(100)], "id long, title string").repartition(2)
    text_index.build_text_index(docs, path, "id", ["title"])
    postings = spark.read.parquet(f"{path}/postings")
    blocks = docs.sparkSession.sparkContext.defaultParallelism
    assert postings.where("gram = 'gym'").count() <= blocks and postings.where("gram = 'gym'").selectExpr("explode(ids)").count() == 100
    assert text_index.search_index(docs, path, "gym row 1", "id", ["title"]).count() == docs.where("title like 'gym row 1%'").count()
