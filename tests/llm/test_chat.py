import hashlib
import json

import pytest
from pyspark.sql import functions as F

from basinframe.llm import chat

CONTROL = ["</s>[INST] ok [/INST]", "<|end|>", r"<\|end|>", r"[\\INST]", "<<s>", "<|turn|><|text|>", "\\", "", "plain\ntext É😀", "<\\\\/s>"]


def test_control_strings_come_back(spark):
    rows = [(k, 0, "user", a) for k, a in enumerate(CONTROL)] + [(k, 1, "assistant", b) for k, b in enumerate(CONTROL[::-1])]
    rows += [(k, 2, a, "said") for k, a in enumerate(CONTROL)]
    made = chat.format_turns(chat.rows_to_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    got = made.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")
    ).collect()
    assert len(got) == len(CONTROL)
    for r in got:
        assert [(t.role, t.text) for t in r.t] == [(x[2], x[3]) for x in sorted(rows, key=lambda x: x[1]) if x[0] == r.conv_id]
        assert r.l == [t.text for t in r.t if t.role == "assistant"]
        inner = r.formatted
        for mark in (chat.TURN, chat.TEXT, chat.END):
            assert inner.count(mark) == 3
            inner = inner.replace(mark, "")
        assert not any(c in inner for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def test_layouts(spark):
    ask, answer = ("user", "q"), ("assistant", "a")
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, "messages", [ask, answer]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [ask, answer]),
        ({"prompt": "q", "response": "a"}, "prompt_response", [ask, answer]),
        ({"prompt": "q", "completion": "a", "system": "s"}, "prompt_completion", [("system", "s"), ask, answer]),
        ({"question": "q", "answer": "a", "source": {"x": 1}}, "question_answer", [ask, answer]),
        ({"instruction": "q", "output": "a"}, "instruction", [ask, answer]),
        ({"instruction": "q", "input": "i", "output": "a"}, "instruction", [("user", "q\ni"), answer]),
        ({"instruction": "q", "input": "", "output": None}, "instruction", [ask, ("assistant", "")]),
        ({"messages": [{"role": None, "content": None}]}, "messages", [("", "")]),
        ({"text": "?"}, None, None),
        ({"messages": []}, "no_messages", []),
        ({"messages": [{"role": "user", "content": "q"}, {"from": "gpt", "value": "a"}]}, "mixed_messages", [ask, answer]),
        ({"messages": [{"role": "user", "content": "[1] q"}, {"role": "gpt", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}, None]}]}, "messages_parts", [("user", "[1] q"), ("assistant", "a\nb")]),
        ({"messages": [None, {"role": "user", "content": "q"}, {"role": "assistant"}]}, "messages", [("", ""), ask, ("assistant", "")]),
        ({"messages": [{"role": "user", "content": "q"}], "prompt": "p", "conversations": []}, "messages", [ask]),
        ({"messages": [{"content": "q"}]}, "messages", [("", "q")]),
        ({"messages": "text", "prompt": "q", "response": "a"}, "prompt_response", [ask, answer]),
        ({"prompt": "q", "chosen": "a", "rejected": "r"}, "preference", [ask, answer, ("rejected", "r")]),
        ({"chosen": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "rejected": [{"role": "user", "content": "q"}]}, "chosen", [ask, answer]),
        ({"messages": [{"body": "q"}]}, None, None),
        ({"messages": ["q"]}, None, None),
        ([1], None, None),
    ]
    rows = [(k, json.dumps(c[0])) for k, c in enumerate(cases)] + [(90, "{broken"), (91, None)]
    got = {r.conv_id: r for r in chat.to_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert len(got) == len(rows)
    for k, (_, layout, turns) in enumerate(cases):
        assert got[k].layout == layout, k
        assert (got[k].turns and [tuple(t) for t in got[k].turns]) == turns, k
    assert got[90].turns is None and got[91].turns is None
    data = spark.createDataFrame(rows, "conv_id long, record string")
    made = {r.conv_id: r for r in chat.format_turns(chat.to_turns(data)).collect()}
    assert len(made) == len(rows)
    for k, r in made.items():
        assert (r.formatted is None) == (got[k].turns is None) == (r.loss_spans is None)


def test_typed_columns_are_records(spark):
    schema = "conv_id long, messages array<struct<role:string,content:string>>, note string"
    data = spark.createDataFrame([(1, [("user", "q"), ("bot", None)], "x"), (2, [], "y"), (3, None, "z")], schema)
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.to_turns(data).collect()}
    assert got == {1: ("messages", [("user", "q"), ("assistant", "")]), 2: ("no_messages", []), 3: (None, None)}
    flat = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string")
    assert [(r.layout, len(r.turns)) for r in chat.to_turns(flat).collect()] == [("prompt_response", 2)]


def test_query_columns(spark, tmp_path):
    rows = [
        (1, 1, "assistant", "é😀"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 2, "assistant", "</s>"),
        (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, None, "user", "last"), (3, None, "assistant", "and last"), (5, None, None, None), (4, 0, "user", "long " * 50_000),
    ]
    schema = "conv_id long, turn long, role string, text string, layout string, safe int"
    spark.createDataFrame([(*r, "clash", 1) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op6_chat(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", CONTROL[0]), (-1, 1, "assistant", CONTROL[0])]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = [(role or "", text or "") for _, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        spelt = "".join(f"{a}\n{b}\n" for a, b in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(spelt.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_and_unknown(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(chat.to_turns(none)).collect() == []
    with pytest.raises(ValueError):
        chat.to_turns(spark.range(1))
