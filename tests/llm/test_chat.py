import json
import random

import pytest
from pyspark.sql import functions as F

from brevier.llm import chat as C

TURN = "conv_id long, turn long, role string, text string, formatted string, loss int"


def chats(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TURN)
    made = C.format_chats(C.canonical_turns(C.turn_rows(frame)), **how)
    template = how.get("template", C.Template())
    read = made.withColumns({"turns": C.read_turns(F.col("formatted"), template), "learnt": C.read_loss(F.col("formatted"), F.col("loss"))})
    return {r.conv_id: r for r in read.collect()}


def test_any_text_comes_back(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "</", "s>", " ", "\n", "é", "\U0001f600", "$1", "ok", "<<s>", "[[INST]]", "<\\s>"]
    noise = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    rows = [(k, t, rng.choice(["user", "assistant", "system", noise(), None]), rng.choice([noise(), noise(), None])) for k in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, 0, "assistant", "long </s>" * 20_000), (99, 0, "assistant", "long </s>" * 20_000), (None, None, None, None), (None, 2, "assistant", "z"), (5, None, "user", "first")]
    rng.shuffle(rows)
    got = chats(spark, rows)
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, role is not None, role or "", text or "") for c, t, role, text in rows if c == conv))
        wanted = [(role, text) for *_, role, text in own]
        assert [(t.role, t.text) for t in r.turns] == wanted
        assert r.learnt == "".join(text for role, text in wanted if role == "assistant")
        for control, n in (("<s>", 1), ("</s>", 1), ("[INST]", 1), ("[/INST]", 1)):
            assert r.formatted.count(control) == n * len(own)
        assert [s.start for s in r.loss] == sorted(s.start for s in r.loss)


def test_other_templates(spark):
    marks = C.Template("<|im_start|>", "\n<|sep|>", "<|im_end|>\n", ("<|im_start|>", "<|sep|>", "<|im_end|>"))
    rows = [(1, 0, "user", "say <|im_end|>"), (1, 1, "assistant", "<|sep|>\\<|im_end|>\n")]
    got = chats(spark, rows, template=marks)[1]
    assert [(t.role, t.text) for t in got.turns] == [r[2:] for r in rows] and got.learnt == rows[1][3]
    assert got.formatted.startswith("<|im_start|>user\n<|sep|>say <\\|im_end|><|im_end|>\n")
    both = chats(spark, rows, loss_roles=("user", "assistant"))[1]
    assert both.learnt == rows[0][3] + rows[1][3]
    for bad in (("ab", "ba"), ("a\\b",), ("a",)):
        with pytest.raises(ValueError):
            C.Template("ab", "ab", "ab", bad)
    with pytest.raises(ValueError):
        C.Template(between=" ")


RECORDS = [
    ({"conv_id": 1, "messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}, [("system", "be kind"), ("user", "hi"), ("assistant", "yes")]),
    ({"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, {"from": "tool", "value": "t"}]}, [("user", "q"), ("assistant", ""), ("tool", "t")]),
    ({"response": "r", "prompt": "p", "conv_id": 3}, [("user", "p"), ("assistant", "r")]),
    ({"response": "r", "prompt": "p", "system": "s", "conv_id": 4}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"conv_id": 5, "completion": "r", "prompt": 12.5}, [("user", "12.5"), ("assistant", "r")]),
    ({"conv_id": 6, "instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"conv_id": 7, "instruction": "do", "input": "", "output": None}, [("user", "do")]),
    ({"conv_id": 8, "example": {"question": {"text": "why"}, "answer": {"text": "so"}}}, [("user", "why"), ("assistant", "so")]),
    ({"conv_id": 9, "messages": []}, []),
    ({"conv_id": 9, "messages": None}, []),
    ({"conv_id": 10, "turn": 3, "role": "user", "text": "flat"}, [("user", "flat")]),
]


def test_layouts_are_chosen_by_fingerprint(spark):
    odd = [{"conv_id": 20, "messages": [{"role": "user", "body": "x"}]}, {"conv_id": 21, "prompt": {"text": "x"}, "response": "y"}, {}, [1, 2], 5, None, {"conv_id": 22, "x y": "STRING", "a.b": [[1], [2]]}]
    texts = [json.dumps(r) for r, _ in RECORDS] + [json.dumps(r) for r in odd] + ["{not json", None]
    records = C.json_records(spark.createDataFrame([(t, 1) for t in texts], "json string, record int"))
    turns = C.canonical_turns(records).collect()
    for record, wanted in RECORDS:
        own = sorted((t for t in turns if t.conv_id == record["conv_id"]), key=lambda t: t.part)
        assert [(t.role, t.text) for t in own] == wanted, record
    assert len(turns) == sum(len(w) for _, w in RECORDS)
    lost = C.unmapped(records).collect()
    assert sum(r.n for r in lost) == len(odd) + 2
    assert {r.structure: r.n for r in lost}["OBJECT<conv_id, messages: ARRAY<OBJECT<body, role>>>"] == 1
    extra = C.Layout("bodies", ("messages[].role", "messages[].body"), ("conv_id",), each="messages", role="role", text="body", conv="conv_id")
    more = C.canonical_turns(records, (extra, C.TURN_ROW)).collect()
    assert sorted((t.conv_id, t.text) for t in more) == [(10, "flat"), (20, "x")]
    with pytest.raises(ValueError):
        C.which_layout(F.col("record"), (C.TURN_ROW, C.TURN_ROW))


def test_structure_of_records_equals_that_of_paths(spark):
    paths = ("b.c[].d", "b.c[].e.f", "a", "z[]", "b.g")
    text = json.dumps({"z": [1, 2], "a": 1.5, "b": {"g": None, "c": [{"d": "x", "e": {"f": True}}, {"d": 1}]}})
    got = C.json_records(spark.createDataFrame([(text,)], "json string")).select(C.structure_of(F.col("record"))).first()[0]
    assert got == C.structure(paths) == "OBJECT<a, b: OBJECT<c: ARRAY<OBJECT<d, e: OBJECT<f>>>, g>, z: ARRAY<>>"


def test_empty_tables(spark):
    assert chats(spark, []) == {}
    assert C.unmapped(C.json_records(spark.createDataFrame([], "json string"))).count() == 0
