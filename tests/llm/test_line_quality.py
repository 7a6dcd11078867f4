import math
import re
from collections import Counter

import duckdb

from brevier.llm.line_quality import quality_rules
from brevier.llm.oracles import OP5


def slow(rows, most, max_removed=0.5):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    lines = lambda t: [x for x in (t or "").split("\n") if split(x)]
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    held = Counter((host, line) for host, line, _ in {(h, normal(x), k) for k, t, h in rows for x in lines(t)})
    out = []
    for doc_id, text, host in rows:
        words = split(text)
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        gone = sum(len(split(x)) for x in lines(text) if held[host, normal(x)] > most)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        own = lines(text)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(covered), gone, failed, not failed and gone <= max_removed * len(words)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, nasty, empty):
    extra = [(k, f"Menu {k} | Home & Shop\nOwn words number{k} " + " ".join(f"v{k}x{j}" for j in range(30 if k % 2 else 2)) + "\n" + "Read more about our terms of use and our cookies policy here now " * (k % 3), "h") for k in range(100, 112)]
    rows = [(r.doc_id, r.text, r.source) for r in nasty.collect()] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (2, 20):
        got = quality_rules(docs, max_documents=least)
        assert sorted([tuple(r) for r in got.collect()], key=repr) == slow(rows, least)
    assert quality_rules(docs, max_documents=2).where("not kept and not base_failed").count() > 0
    assert quality_rules(empty).count() == 0


def test_rows_of_one_id_count_as_one_document(spark):
    text = "A line with some words of its own. " * 4 + "\nAnother line"
    rows = [(1, text, "h")] * 4 + [(None, text, "h")] * 3 + [(1, "Another line", "h"), (2, "Another line\nAnother line", "h"), (2, text, "other")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, n int, line string")
    for most in (1, 2, 3):
        got = quality_rules(docs, max_documents=most)
        assert sorted([tuple(r) for r in got.collect()], key=repr) == slow(rows, most)
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    got = sorted([tuple(r[c] for c in sorted(r.asDict())) for r in quality_rules(docs).withColumnRenamed("id", "doc_id").collect()], key=repr)
    told = duck.sql(OP5).df()
    told["doc_id"] = [None if math.isnan(x) else int(x) for x in told["doc_id"].astype(float)]
    assert got == sorted([tuple(None if v is None or v != v else v for v in r) for r in told[sorted(told.columns)].astype(object).values.tolist()], key=repr)


def test_main_path_has_no_python(nasty):
    plan = quality_rules(nasty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
