"""Chat templates as rows: slots of text and tokens, interpreted for whole conversations, as text or as token ids."""

from __future__ import annotations

from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.binding import let

SLOTS = "array<struct<kind:string,value:string>>"
PARTS = ("prefix", "user", "assistant", "system", "observation")
#: A template's row. ``merged``: the system text stands inside the first user turn.
SCHEMA = f"name string, {', '.join(f'{p} {SLOTS}' for p in PARTS)}, default_system string, merged boolean"
#: Characters of a text whose ids a task keeps for the rows that follow.
KEPT = 8192
KINDS = ("text", "token", "bos", "eos")

BOS, EOS = ("bos", ""), ("eos", "")


def _token(value: str) -> tuple[str, str]:
    return ("token", value)


def _marked(begin: str, end: str, names: tuple[str, str, str, str] = ("user", "assistant", "system", "tool"), gap: str = "\n", after: str = "\n") -> dict:
    """The slots of a family of templates that put each turn between marks, under the name of its role."""
    user, assistant, system, tool = names
    ask = f"{end}{after}{begin[0]}{assistant}{begin[1]}{gap}"
    turn = lambda name: f"{begin[0]}{name}{begin[1]}{gap}{{{{content}}}}"
    return {"user": [turn(user) + ask], "assistant": ["{{content}}" + end + after], "system": [turn(system) + end + after], "observation": [turn(tool) + ask]}


# The formats of chat models. Text slots are strings with {{content}} (and {{idx}}); parts that are left out
# are those of the function ``rows``.
TEMPLATES: dict[str, dict] = {
    "default": {"user": ["Human: {{content}}", EOS, "\nAssistant:"], "assistant": ["{{content}}", EOS, "\n"], "system": ["System: {{content}}", EOS, "\n"]},
    "empty": {"assistant": ["{{content}}"]},
    "fewshot": {"assistant": ["{{content}}\n\n"]},
    "alpaca": {"user": ["### Instruction:\n{{content}}\n\n### Response:\n"], "assistant": ["{{content}}", EOS, "\n\n"], "default_system": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"},
    "vicuna": {"user": ["USER: {{content}} ASSISTANT:"], "default_system": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."},
    "chatml": _marked(("<|im_start|>", ""), "<|im_end|>"),
    "qwen": _marked(("<|im_start|>", ""), "<|im_end|>") | {"observation": ["<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n"], "default_system": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."},
    "ernie": _marked(("<|im_start|>", ""), "<|im_end|>", after="\n\n"),
    "granite3": _marked(("<|start_of_role|>", "<|end_of_role|>"), "<|end_of_text|>", gap="") | {"observation": None},
    "llama3": _marked(("<|start_header_id|>", "<|end_header_id|>"), "<|eot_id|>", ("user", "assistant", "system", "ipython"), "\n\n", "") | {"prefix": [BOS]},
    "cohere": {"user": ["<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>"], "system": ["<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>"], "prefix": [BOS]},
    "llama2": {"user": [BOS, "[INST] {{content}} [/INST]"], "system": ["<<SYS>>\n{{content}}\n<</SYS>>\n\n"], "merged": True},
    "mistral": {"user": ["[INST] {{content}}[/INST]"], "assistant": [" {{content}}", EOS], "system": ["{{content}}\n\n"], "prefix": [BOS], "observation": ['[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]'], "merged": True},
    "breeze": {"user": ["[INST] {{content}} [/INST] "], "prefix": [BOS]},
    "gemma": _marked(("<start_of_turn>", ""), "<end_of_turn>", ("user", "model", "system", "tool")) | {"system": ["{{content}}\n\n"], "prefix": [BOS], "merged": True},
    "deepseek": {"user": ["User: {{content}}\n\nAssistant:"], "system": ["{{content}}\n\n"], "prefix": [BOS]},
    "deepseek3": {"user": ["<｜User｜>{{content}}<｜Assistant｜>"], "prefix": [BOS]},
    "falcon": {"user": ["User: {{content}}\nFalcon:"], "assistant": ["{{content}}\n"]},
    "exaone": {"user": ["[|user|]{{content}}\n[|assistant|]"], "assistant": ["{{content}}", EOS, "\n"], "system": ["[|system|]{{content}}[|endofturn|]\n"]},
    "chatglm2": {"user": ["[Round {{idx}}]\n\n问：{{content}}\n\n答："], "prefix": [_token("[gMASK]"), _token("sop")], "assistant": ["{{content}}"]},
    "chatglm3": {
        "user": [_token("<|user|>"), "\n", "{{content}}", _token("<|assistant|>")], "assistant": ["\n", "{{content}}"], "system": [_token("<|system|>"), "\n", "{{content}}"],
        "observation": [_token("<|observation|>"), "\n", "{{content}}", _token("<|assistant|>")], "prefix": [_token("[gMASK]"), _token("sop")],
    },
    "glm4": {"user": ["<|user|>\n{{content}}<|assistant|>"], "assistant": ["\n{{content}}"], "system": ["<|system|>\n{{content}}"], "observation": ["<|observation|>\n{{content}}<|assistant|>"], "prefix": ["[gMASK]<sop>"]},
}


def rows(templates: dict[str, dict]) -> list[tuple]:
    """Templates as rows of SCHEMA. A user turn and a system text that aren't given are the bare content, an answer is
    the content and the end of the sequence, what a tool says is a user turn. Refused are unknown parts and kinds, turns
    without a text that holds {{content}}, and a prefix that holds one."""
    out = []
    for name, t in templates.items():
        unknown = t.keys() - {*PARTS, "default_system", "merged"}
        if unknown:
            raise ValueError(f"{name}: unknown parts {', '.join(sorted(unknown))}")
        user = t.get("user") or ["{{content}}"]
        parts = [t.get("prefix") or [], user, t.get("assistant") or ["{{content}}", EOS], t.get("system") or ["{{content}}"], t.get("observation") or user]
        slots = [[("text", s) if isinstance(s, str) else tuple(s) for s in p] for p in parts]
        for part, own in zip(PARTS, slots, strict=True):
            if any(k not in KINDS for k, _ in own):
                raise ValueError(f"{name}: a slot of {part} is of an unknown kind")
            if any(k == "text" and "{{content}}" in v for k, v in own) == (part == "prefix"):
                raise ValueError(f"{name}: {part} has to hold {'no' if part == 'prefix' else 'a'} content")
        out.append((name, *slots, t.get("default_system", ""), bool(t.get("merged", False))))
    return out


def table_of(spark: SparkSession, templates: dict[str, dict] | None = None) -> DataFrame:
    """Templates as a table, the known ones if none are given; tables of the same columns from files do as well."""
    return spark.createDataFrame(rows(TEMPLATES if templates is None else templates), SCHEMA)


def _filled(slots: Column, content: Column, turn: Column) -> Column:
    """Slots with the content and the pair's number in their texts. What stands in the content is never replaced."""
    numbered = lambda t: F.replace(t, F.lit("{{idx}}"), F.floor(turn / 2).cast("string"))

    def text(v: Column) -> Column:
        at = F.instr(v, "{{content}}")
        return F.when(at == 0, numbered(v)).otherwise(F.concat(numbered(F.substr(v, F.lit(1), at - 1)), content, numbered(F.substr(v, at + 11))))

    return F.transform(slots, lambda s: F.struct(turn.cast("int").alias("turn"), s["kind"].alias("kind"), F.when(s["kind"] == "text", text(s["value"])).otherwise(s["value"]).alias("value")))


def elements(turns: Column, template: Column) -> Column:
    """The elements (turn, kind, value) of a conversation, an array of (role, content) in order, in a template's row.

    A system turn at the beginning is the system text, else it is the template's own. It stands behind the prefix before
    the first turn, or inside it where the template says so and it is a user's. Roles are user, assistant, system and tool (or observation);
    a conversation with another one, with a system turn elsewhere or with a null turn has no elements (null), one
    without turns has none (empty). Null contents are empty.
    """
    said = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))

    def whole(c: Column) -> Column:
        has = F.coalesce(F.get(c, F.lit(0))["role"] == "system", F.lit(False))
        system = F.when(has, F.get(c, F.lit(0))["content"]).otherwise(F.lit(""))
        system = F.when(system == "", template["default_system"]).otherwise(system)
        return let(F.struct(system.alias("system"), F.when(has, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c).alias("rest")), laid_out)

    def laid_out(p: Column) -> Column:
        in_front = _filled(template["system"], p["system"], F.lit(0))
        merged = F.array_join(F.transform(F.filter(in_front, lambda e: e["kind"] == "text"), lambda e: e["value"]), "")
        nothing = F.array().cast("array<struct<turn:int,kind:string,value:string>>")
        inside = template["merged"] & (F.get(p["rest"], F.lit(0))["role"] == "user")
        opening = F.concat(_filled(template["prefix"], F.lit(""), F.lit(0)), F.when((p["system"] != "") & ~inside, in_front).otherwise(nothing))

        def one(m: Column, i: Column) -> Column:
            content = F.when((i == 0) & inside & (p["system"] != ""), F.concat(merged, m["content"])).otherwise(m["content"])
            slots = F.when(m["role"] == "user", template["user"]).when(m["role"] == "assistant", template["assistant"]).when(m["role"].isin("tool", "observation"), template["observation"])
            own = _filled(slots, content, i)
            return F.when(i == 0, F.concat(opening, own)).otherwise(own)

        return F.flatten(F.transform(p["rest"], one))

    return let(said, whole)


def as_text(parts: Column, bos: str, eos: str) -> Column:
    value = lambda e: F.when(e["kind"] == "bos", bos).when(e["kind"] == "eos", eos).otherwise(e["value"])
    return F.array_join(F.transform(parts, value), "")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=512)
def _short_ids(path: str, text: str) -> array:
    """The ids of a text of KEPT characters at most: templates of one conversation have many texts in common."""
    return array("i", _tokenizer(path).encode(text, add_special_tokens=False).ids)


def with_ids(df: DataFrame, column: str, path: str, bos: str | None, eos: str | None, name: str = "ids") -> DataFrame:
    """``df`` with the struct ``name`` (ids, ends) in place of the elements' ``column``: the token ids of all elements,
    each text encoded by itself, and where each turn ends among them, so that every prompt of a conversation is a prefix
    of one array. Tokens are looked up (one that the vocabulary lacks is encoded as text); without a begin or end of
    sequence (None) those slots are left out. ``path`` names a tokenizer's file that all machines have. Conversations
    without elements have null or no ids."""
    others = [c for c in df.columns if c not in (column, name)]
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
    arrow = pa.struct([("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def ids_of(parts: list[dict]) -> dict:
        tokenizer, ids, ends = _tokenizer(path), [], []
        for e in parts:
            while len(ends) <= e["turn"]:
                ends.append(len(ids))
            value = bos if e["kind"] == "bos" else eos if e["kind"] == "eos" else e["value"]
            known = tokenizer.token_to_id(value) if e["kind"] != "text" and value is not None else None
            if known is not None:
                ids.append(known)
            elif value:
                ids += _short_ids(path, value) if len(value) <= KEPT else tokenizer.encode(value, add_special_tokens=False).ids
            ends[-1] = len(ids)
        return {"ids": ids, "ends": ends}

    def run(batches):
        for b in batches:
            found = [None if parts is None else ids_of(parts) for parts in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(found, arrow)], [*others, name])

    return df.select(*others, column).mapInArrow(run, T.StructType([*(df.schema[c] for c in others), T.StructField(name, kind)]))


def one_turn(e: Column) -> Column:
    """(prompt, response): the ids before the last turn, and the last turn's."""
    last = F.coalesce(F.try_element_at(e["ends"], F.lit(-2)), F.lit(0))
    return F.struct(F.slice(e["ids"], F.lit(1), last).alias("prompt"), F.slice(e["ids"], last + 1, F.size(e["ids"]) - last).alias("response"))


def turn_pairs(e: Column) -> Column:
    """(start, middle, stop) of each prompt and answer among the ids; a last turn without an answer is left out."""
    at = lambda i: F.when(i < 1, 0).otherwise(F.try_element_at(e["ends"], i))
    pairs = F.floor(F.size(e["ends"]) / 2).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), pairs), F.lit(1), pairs), lambda k: F.struct(at(2 * k).alias("start"), at(2 * k + 1).alias("middle"), at(2 * k + 2).alias("stop")))
