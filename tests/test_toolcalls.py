"""Tool calls in all dialects: round trips, broken texts, texts around calls."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import toolcalls

SINGLE = {"glm4"}
CALLS = [("get_weather", '{"city": "São Paulo", "days": 3, "units": null, "deep": {"a": [1, {"b": "}{<"}], "c": true}}'), ("noop", "{}"), ("f2", '{"text": "two\\nlines and \\"quotes\\"", "flag": false, "x": -1.5e-3}')]


@pytest.mark.parametrize("name", sorted(toolcalls.DIALECTS))
def test_round_trip(name):
    groups = [[c] for c in CALLS] if name in SINGLE else [CALLS, CALLS[:1], CALLS[1:]]
    for calls in groups:
        text = toolcalls.written(calls, name)
        got = toolcalls.read(text, name)
        assert [(n, json.loads(a)) for n, a in got] == [(n, json.loads(a)) for n, a in calls], text
    assert toolcalls.written([], name) is None and toolcalls.written([("f", "{broken")], name) is None
    if name in SINGLE:
        assert toolcalls.written(CALLS, name) is None


def test_random_round_trips():
    rng = random.Random(4)

    def value(depth=0):
        if depth < 3 and rng.random() < 0.3:
            return rng.choice([lambda: [value(depth + 1) for _ in range(rng.randint(0, 3))], lambda: {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 3))}])()
        return rng.choice([rng.randint(-9, 9), rng.random(), True, False, None, "".join(rng.choice("ab {}[],:'é") for _ in range(rng.randint(0, 6))) + "z", "word"])

    for _ in range(300):
        calls = [(f"f{rng.randrange(9)}", json.dumps({f"a{i}": value() for i in range(rng.randint(0, 4))}, ensure_ascii=False)) for _ in range(rng.randint(1, 3))]
        for name in toolcalls.DIALECTS:
            own = calls[:1] if name in SINGLE else calls
            # white space around a text without marks of its own is not kept
            if toolcalls.DIALECTS[name].kind == "tags":
                own = [(n, json.dumps({k: v.strip() if isinstance(v, str) else v for k, v in json.loads(a).items()}, ensure_ascii=False)) for n, a in own]
            got = toolcalls.read(toolcalls.written(own, name), name)
            assert [(n, json.loads(a)) for n, a in got] == [(n, json.loads(a)) for n, a in own], name


BROKEN = {
    "default": ["Action: f", "Action: f\nAction Input: {broken", "nothing"], "glm4": ["f {}", "f\n{broken", "f"], "llama3": ['{"name": "f"}', '[{"parameters": {}}]', "[]", "7", '{"name": 3, "parameters": {}}', '{"name": "f", "arguments": {}}'], "mistral": ['{"name": "f"}', "x", "[1]"],
    "minimax1": ["<tool_calls>", "x"], "qwen": ["<tool_call>{broken}</tool_call>", '<tool_call>{"name": "f"}</tool_call>', '<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call> and more', "<tool_call>"], "hermes": ["<tool_call>{broken}</tool_call>", "<tool_call>"], "qwen3_5": ["<tool_call></tool_call>", "<function=f></function>"],
    "seed": ["<seed:tool_call></seed:tool_call>"], "minimax2": ['<invoke name="f"></invoke>', "<minimax:tool_call>x</minimax:tool_call>"], "glm4_moe": ["<tool_call>", "x"],
    "lfm2": ["<|tool_call_start|>", "<|tool_call_start|>[f(]<|tool_call_end|>", "<|tool_call_start|>[f(x)]<|tool_call_end|>", "<|tool_call_start|>[f(a=b)]<|tool_call_end|>", "<|tool_call_start|>[f(a=open('x'))]<|tool_call_end|>", "<|tool_call_start|>[1]<|tool_call_end|>", "<|tool_call_start|>[]<|tool_call_end|>"],
    "gpt_oss": ["<|start|>assistant<|channel|>final<|message|>hi<|end|>", "<|call|>"],
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_texts_are_no_calls(name):
    for text in [*BROKEN[name], "", "[" * 100_000, "x" * (toolcalls.CHARS + 1)]:
        assert toolcalls.read(text, name) is None, text[:80]


def test_what_stands_around_calls():
    text = 'hello <tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call> and <tool_call>{broken</tool_call>bye'
    assert toolcalls.read_with_rest(text, "hermes") == ("hello  and bye", [("f", '{"a": 1}')])
    call = toolcalls.written([("f", '{"a": 1}')], "gpt_oss")
    text = f"<|channel|>analysis<|message|>maybe {call}?<|end|>{call}<|start|>assistant<|channel|>final<|message|>done<|end|>"
    assert toolcalls.read_with_rest(text, "gpt_oss") == ("<|start|>assistant<|channel|>final<|message|>done<|end|>", [("f", '{"a": 1}')])
    assert toolcalls.read('<tool_calls>\n{broken\n{"name": "f", "arguments": {}}\n</tool_calls>', "minimax1") == [("f", "{}")]
    assert toolcalls.read('<tool_call>{"name": "f", "arguments": {"a": "</tool_call> inside"}}</tool_call>', "qwen") == [("f", '{"a": "</tool_call> inside"}')]
    assert toolcalls.read("<tool_call>f\n<arg_key>a</arg_key>\n<arg_value>1</arg_value>\n</tool_call>", "glm4_moe") == [("f", '{"a": 1}')]
    with pytest.raises(ValueError):
        toolcalls.read_with_rest("", "qwen")


def test_columns(spark):
    df = spark.createDataFrame([(n, [CALLS[0]]) for n in toolcalls.DIALECTS] + [("unknown", [CALLS[0]]), (None, [CALLS[0]]), ("qwen", None), ("qwen", [])], f"d string, c {toolcalls.KIND}")
    out = df.withColumn("t", toolcalls.formatted(F.col("c"), F.col("d"))).withColumn("x", toolcalls.extracted(F.col("t"), F.col("d"))).collect()
    for r in out:
        assert (r.x is None and r.t is None) if r.d in ("unknown", None) or not r.c else (r.x[0].name, json.loads(r.x[0].arguments)) == (CALLS[0][0], json.loads(CALLS[0][1]))
    assert len(out) == 18
    turn = spark.createDataFrame([("a<tool_call>{}</tool_call>b",), (None,)], "t string").select(toolcalls.agent_turn(F.col("t"), "hermes").alias("r")).collect()
    assert turn[0].r.rest == "ab" and turn[0].r.calls == [] and turn[1].r.rest is None
    for wrong in (lambda: toolcalls.formatted(F.col("c"), "none"), lambda: toolcalls.agent_turn(F.col("t"), "qwen")):
        with pytest.raises(ValueError):
            wrong()
