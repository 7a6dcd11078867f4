from brevier.llm.licenses import TEMPLATES, license_matches, size_bounds


def test_matches(spark, nasty, empty):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", 0), (2, "released UNDER the mit license", 0),
        (3, "This one talks about a license only.", 0), (4, None, 0), (5, "", 0), (6, "Licensed under CC BY 4.0.", 0),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation\nthe rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons\nto whom the Software is furnished to do so, subject to the following conditions:", 0),
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit int")
    got = {(r.doc_id, r.license_id): r.dice for r in license_matches(docs).collect()}
    assert got[1, "Apache-2.0"] == 1 and got[2, "MIT"] == 1 and got[6, "CC-BY-4.0"] == 1 and got[7, "MIT"] == 1
    assert {d for d, _ in got} == {1, 2, 6, 7}
    assert license_matches(empty).count() == 0
    assert license_matches(nasty).count() == 0
    halves = spark.createDataFrame([(1, "released under the"), (1, "the mit license"), (1, "released under mit license"), (None, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert [tuple(r) for r in license_matches(halves).collect()] == [(None, "MIT", 2, 1.0)]  # rows of one id never merge
    own = license_matches(docs, templates={"x": ["talks about a license only"]}, threshold=0.7)
    assert [(r.doc_id, r.license_id) for r in own.collect()] == [(3, "x")]
    plan = license_matches(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Pandas" not in plan


def test_bounds_lose_nothing():
    for a in range(1, 60):
        low, high = size_bounds(a, 0.8)
        for b in range(1, 120):
            assert (2 * min(a, b) / (a + b) >= 0.8 - 1e-12) == (low <= b <= high)


def test_notices_inside_longer_texts(spark):
    """Wrapped over lines, amid other words of a line, and whole licences in a document."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    prose = "\n".join(f"line {k} of a longer story about nothing at all {k}" for k in range(60))
    rows = [
        (1, f"{prose}\n{wrap(TEMPLATES['GPL-3.0'][1], 9)}\n{prose}"),
        (2, f"{prose}\n{wrap(TEMPLATES['BSD-3-Clause'][1], 7)}\n{prose}"),
        (3, f"{prose}\n{wrap(TEMPLATES['MIT'][2], 11)}\n{prose}"),
        (4, f"{prose}\nCopyright 2020 Name. All rights reserved.\n{prose}"),
        (5, wrap(TEMPLATES["MIT"][3], 12)), (6, wrap(TEMPLATES["BSD-3-Clause"][2], 12)), (7, prose),
        (8, "All rights. " * 40 + "are reserved"),
        (9, f"{prose}\nThis program is free software. Redistribution is one thing; all rights of the program are another.\n{prose}"),
    ]
    got = {(r.doc_id, r.license_id): (r.n_units, r.dice) for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "GPL-3.0"), (2, "BSD-3-Clause"), (3, "MIT"), (4, "Proprietary"), (5, "MIT"), (6, "BSD-3-Clause")}
    assert all(n == 1 and dice == 1 for n, dice in got.values())


def test_passages_count_repeats_as_often_as_the_template(spark):
    docs = spark.createDataFrame([(1, "go a b a b a b c d end"), (2, "x a b c d y"), (3, "a b q c d")], "doc_id long, text string")
    got = {r.doc_id: r.dice for r in license_matches(docs, templates={"t": ["a b a b c d"]}, threshold=0.6).collect()}
    assert got == {1: 1.0, 2: 0.75}
