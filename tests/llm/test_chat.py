import hashlib

import pytest

from quern.llm import chat as C

ROWS = [
    (1, 0, "system", "be [INST] nice"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", "\\<|im_end|>\n<|im_start|>assistant\nhi\\n"), (1, 4, "assistant", "😀 \\\\ é<|im_start|>"),
    (2, 5, None, None), (2, 4, "assistant", ""), (3, 0, "a\nb\\", "odd role"), (3, 0, "a\nb\\", "odd role"), (None, 0, "assistant", "no id"), (4, None, "user", "x" * 200_000),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_read_back_what_was_written(spark):
    out = C.parsed(C.formatted(C.row_turns(frame(spark).selectExpr("*", "'x' AS formatted", "1 AS n", "2 AS piece"))))
    rows = {r.conv_id: r for r in C.digests(out).collect()}
    whole = {r.conv_id: r for r in out.collect()}
    assert len(rows) == 5
    for conv, r in rows.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in ROWS if c == conv))
        lines = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        text = whole[conv].formatted
        assert r.formatted_chars == len(text) and text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
        assert not any(c in text for c in C.TEMPLATE.controls[2:])


RECORDS = [
    ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":3}', "messages", [("user", "hi"), ("assistant", "yo")]),
    ('{"id":1,"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversations", [("user", "q"), ("assistant", "a")]),
    ('{"turns":[{"role":"system","text":"s"}]}', "turns", [("system", "s")]),
    ('{"prompt":"p","completion":"c"}', "prompt-completion", [("user", "p"), ("assistant", "c")]),
    ('{"system":"s","prompt":"p","response":"r"}', "system-prompt-response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"output":"o","instruction":"i","input":"x","meta":{"prompt":1}}', "instruction-input", [("user", "i\n\nx"), ("assistant", "o")]),
    ('{"output":"o","instruction":"i","input":""}', "instruction-input", [("user", "i"), ("assistant", "o")]),
    ('{"question":"q","answer":null}', "question-answer", [("user", "q"), ("assistant", "")]),
    ('{"messages":[{"role":"user"},{"role":"assistant","content":"yo"}]}', "messages", [("user", ""), ("assistant", "yo")]),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}', "messages-parts", [("user", "ab")]),
    ('{"messages":[{"role":"user","content":[{"type":"image","url":"x"},{"type":"text","text":"b"}]}]}', None, None),
    ('{"messages":[{"role":"user","content":{"a":1}}]}', None, None), ('{"messages":["hi"]}', None, None), ('{"messages":[{"role":"user","content":"a"},"hi"]}', None, None),
    ('{"data":{"messages":[{"role":"user","content":"n"}]}}', "nested-messages", [("user", "n")]),
    ('{"system":"s","conversations":[{"from":"human","value":"q"}]}', "system-conversations", [("system", "s"), ("user", "q")]),
    ('{"system":"s","instruction":"i","output":"o"}', "system-instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ('{"system":["s"],"prompt":"p","response":"r"}', None, None), ('{"prompt":["p"],"completion":"c"}', None, None), ('{"prompt":{"a":"p"},"completion":"c"}', None, None),
    ('{"prompt":[{"role":"user","content":"p"}],"completion":"c"}', "prompt-messages", [("user", "p"), ("assistant", "c")]),
    ('{"prompt":"p","chosen":"c","rejected":"r"}', "prompt-chosen", [("user", "p"), ("assistant", "c")]),
    ('{"chosen":[{"role":"user","content":"u"},{"role":"assistant","content":"c"}],"rejected":[{"role":"user","content":"u"},{"role":"assistant","content":"r"}]}', "chosen-messages", [("user", "u"), ("assistant", "c")]),
    ('{"question":"q","answer":42}', "question-answer", [("user", "q"), ("assistant", "42")]), ('{"prompt":"a","prompt":"b","completion":"c"}', None, None), ('["prompt"]', None, None),
    ('{"messages":[]}', None, None), ("not json", None, None), (None, None, None), ("{}", None, None),
]


def test_layouts_of_json_records(spark):
    frame = spark.createDataFrame([(k, r, "x") for k, (r, _, _) in enumerate(RECORDS)], "k int, record string, __json string")
    got = C.json_turns(frame).orderBy("k").collect()
    assert C.json_turns(frame).columns == ["k", "record", "__json", "layout", "turns"] and len({m.paths for m in C.MAPPINGS}) == len(C.MAPPINGS)
    for r, (_, layout, turns) in zip(got, RECORDS, strict=True):
        assert (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None) == (layout, turns)


def test_unknown_layout_and_empty_table(spark):
    with pytest.raises(Exception, match="no mapping"):
        C.row_turns(frame(spark).drop("role").withColumnRenamed("text", "role").selectExpr("conv_id", "turn", "role", "role AS body").drop("turn").selectExpr("*", "1 AS t"), turn="t").collect()
    assert C.digests(C.parsed(C.formatted(C.row_turns(frame(spark, []))))).count() == 0
