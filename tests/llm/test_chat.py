import hashlib
import json

import pytest
from pyspark.sql import functions as F

from velumen.llm import chat

SAID = "</s>[INST] ok [/INST]"


def brute(rows):
    """conv_id -> (n_turns, turns digest, loss chars, loss digest)."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 1, "assistant", "\\l</s>\\\\b[x] <s>]"),
    (1, 0, "user", SAID),
    (1, 2, "assistant", "é𝒳 \n] tail"),
    (2, 0, "assistant", None),
    (2, 0, "assistant", "tie"),
    (2, 0, None, "no role"),
    (3, 5, "we[i]rd] role", ""),
    (3, None, "user", "first"),
    (None, 0, "assistant", "x"),
    (4, 0, "assistant", "<|im_end|>" * 5000),
    (5, 0, "user", "twice"),
    (5, 0, "user", "twice"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    got = chat.chat_digest(chat.format_chat(chat.canonical_turns(df))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(ROWS)


def test_marks_stand_only_between_turns_and_the_mask_covers_the_text(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in chat.format_chat(df).collect():
        n = sum(1 for x in ROWS if x[0] == r.conv_id)
        assert r.formatted.count("</s>") == n and r.formatted.count("<") == n + 1 and r.formatted.count("[") == n
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)


def test_only_native_operations(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = chat.chat_digest(chat.format_chat(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


RECORDS = [
    (1, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 7}, "messages", [("user", "a"), ("assistant", "b")]),
    (2, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    (3, {"instruction": "do", "input": "it", "output": "done"}, "instruction_input", [("user", "do\n\nit"), ("assistant", "done")]),
    (4, {"instruction": "do", "output": "done", "source": "x"}, "instruction", [("user", "do"), ("assistant", "done")]),
    (5, {"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    (6, {"prompt": "p", "response": "r", "system": "s"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
]


def test_json_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(r)) for i, r, _, _ in RECORDS] + [(8, '{"other": 1}'), (9, "not json"), (10, None), (11, '{"prompt": "p"}')]
    got = {}
    for r in chat.canonical_json_turns(spark.createDataFrame(rows, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        got.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    assert got == {(i, layout): turns for i, _, layout, turns in RECORDS}


def test_typed_layouts_by_fingerprint(spark):
    assert len(chat.MAPPINGS) == len(chat.LAYOUTS)
    alpaca = spark.createDataFrame([(1, "do", None, "done", "x")], "conv_id long, instruction string, input string, output string, lang string")
    assert [(r.turn, r.role, r.text) for r in chat.canonical_turns(alpaca).collect()] == [(0, "user", "do"), (1, "assistant", "done")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1).select(F.col("id").alias("conv_id")))


@pytest.mark.parametrize("extra", ["prompt", "input", "output", "system", "response", "instruction", "completion", "prompt,response", "system,prompt,response", "instruction,input,output", "messages", "formatted,loss_mask,ts,t"])
def test_further_columns_do_not_matter(spark, extra):
    names = extra.split(",")
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in ROWS], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in names))
    got = chat.chat_digest(chat.format_chat(chat.canonical_turns(df))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(ROWS)


def test_further_fields_of_json_records_do_not_matter(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "a"}], "prompt": "p"}, "messages"),
        (2, {"prompt": "p", "response": "r", "output": "o"}, "prompt_response"),
        (3, {"instruction": "do", "output": "done", "system": "s"}, "instruction"),
        (4, {"instruction": "do", "input": "it", "output": "done", "prompt": "p", "completion": "c"}, "instruction_input"),
    ]
    got = chat.canonical_json_turns(spark.createDataFrame([(i, json.dumps(r)) for i, r, _ in records], "conv_id long, record string"))
    assert {(r.conv_id, r.layout) for r in got.collect()} == {(i, layout) for i, _, layout in records}
    for i, r, layout in records:
        assert chat.recognised([p for p in chat.KNOWN if p.split("[")[0] in r]) == layout, i


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(chat.format_chat(df)).collect() == []
