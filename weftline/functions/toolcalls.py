"""Tool calls in the dialects of model families: a dialect is a row of marks, written and read by its kind."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a text in which calls are looked for; longer texts have none.
CHARS = 1_000_000
KIND = "array<struct<name:string,arguments:string>>"


@dataclass(frozen=True)
class Dialect:
    """``kind``: json (objects, each between ``open`` and ``close``), lines (an object a line, all between them), tags
    (arguments between marks of their own), whole (the text is JSON), action, name, python or channel."""

    kind: str
    open: str = ""
    close: str = ""
    arguments: str = "arguments"
    one: bool = False  # a single call is an object, not a list of one
    strict: bool = True  # a call that can't be read makes the text no call at all; else it is left out
    outer: tuple[str, str] = ("", "")
    argument: str = ""  # the marks around {key} and {value}
    strip: bool = False  # white space around values that are no JSON goes


# The marks of the dialects.
DIALECTS = {
    "default": Dialect("action"),
    "glm4": Dialect("name"),
    "llama3": Dialect("whole", arguments="parameters", one=True),
    "mistral": Dialect("whole"),
    "minimax1": Dialect("lines", "<tool_calls>\n", "\n</tool_calls>", strict=False),
    "qwen": Dialect("json", "<tool_call>\n", "\n</tool_call>"),
    "ling": Dialect("json", "<tool_call>\n", "\n</tool_call>"),
    "hermes": Dialect("json", "<tool_call>\n", "\n</tool_call>", strict=False),
    "qwen3_5": Dialect("tags", "<tool_call>\n<function={name}>", "\n</function>\n</tool_call>", argument="\n<parameter={key}>\n{value}\n</parameter>", strip=True),
    "seed": Dialect("tags", "\n<seed:tool_call>\n<function={name}", "\n</function>\n</seed:tool_call>", argument="\n<parameter={key}>{value}</parameter>"),
    "minimax2": Dialect("tags", '<invoke name="{name}">', "\n</invoke>", outer=("<minimax:tool_call>\n", "\n</minimax:tool_call>"), argument='\n<parameter name="{key}">{value}</parameter>'),
    "glm4_moe": Dialect("tags", "\n<tool_call>{name}", "", argument="\n<arg_key>{key}</arg_key>\n<arg_value>{value}</arg_value>"),
    "lfm2": Dialect("python", "<|tool_call_start|>[", "]<|tool_call_end|>"),
    "gpt_oss": Dialect("channel", "<|start|>assistant<|channel|>commentary to=functions.{name} <|constrain|>json<|message|>", "<|call|>", strict=False),
}


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        raise ValueError("no JSON") from None


def _shown(value: object) -> str:
    return value if isinstance(value, str) else _dump(value)


def _quoted(value: object) -> str:
    return _dump(value)  # strings, numbers, lists and objects of JSON are Python's, but for true, false and null


def written(calls: list[tuple[str, str]], name: str) -> str | None:
    """Calls (name, arguments as JSON) in a dialect; null if arguments are no JSON, no object where keys are asked for,
    there is no call, or there are several in a dialect of single calls."""
    d = DIALECTS[name]
    try:
        values = [_load(a) for _, a in calls]
    except (ValueError, TypeError):
        return None
    if not calls or d.kind == "name" and len(calls) > 1 or d.kind in ("tags", "python") and not all(isinstance(v, dict) for v in values):
        return None
    names = [n for n, _ in calls]
    objects = [{"name": n, d.arguments: v} for n, v in zip(names, values, strict=True)]
    match d.kind:
        case "action":
            return "\n".join(f"Action: {n}\nAction Input: {a}" for n, a in calls)
        case "name":
            return f"{calls[0][0]}\n{calls[0][1]}"
        case "whole":
            return _dump(objects[0] if d.one and len(objects) == 1 else objects)
        case "lines":
            return d.open + "\n".join(map(_dump, objects)) + d.close
        case "json":
            return "\n".join(d.open + _dump(o) + d.close for o in objects)
        case "tags":
            each = (d.open.replace("{name}", n) + "".join(d.argument.replace("{key}", k, 1).replace("{value}", _shown(v), 1) for k, v in a.items()) + d.close for n, a in zip(names, values, strict=True))
            return d.outer[0] + "\n".join(each) + d.outer[1]
        case "python":
            return d.open + ", ".join(f"{n}({', '.join(f'{k}={_quoted(v)}' for k, v in a.items())})" for n, a in zip(names, values, strict=True)) + d.close
    return "".join(d.open.replace("{name}", n) + a + d.close for n, a in calls)


def _mark(text: str) -> str:
    """A pattern of marks that matches with any white space, or none, for theirs."""
    return r"\s*".join(re.escape(p) for p in text.split())


def _tag_patterns(d: Dialect) -> tuple[re.Pattern, re.Pattern]:
    head, tail = d.open.split("{name}")
    key_open, rest = d.argument.split("{key}")
    middle, value_close = rest.split("{value}")
    name = r"\s*(?P<name>[^\s<>\"]+)\s*" + (_mark(tail) if tail else ">?")
    end = _mark(d.close) if d.close else r"(?:</tool_call>|(?=\s*" + _mark(head) + r")|\s*\Z)"
    call = re.compile(_mark(head) + name + r"(?P<body>.*?)" + end, re.DOTALL)
    return call, re.compile(_mark(key_open) + r"(?P<key>.*?)" + _mark(middle) + r"(?P<value>.*?)" + _mark(value_close), re.DOTALL)


_TAGS = {n: _tag_patterns(d) for n, d in DIALECTS.items() if d.kind == "tags"}
_ACTION = re.compile(r"Action:\s*(\w+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*\Z)", re.DOTALL | re.ASCII)
_CHANNEL = re.compile(r"<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>", re.DOTALL)
_THOUGHT = re.compile(r"(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", re.DOTALL)


def _python_value(node: ast.expr) -> object:
    if isinstance(node, ast.Name) and node.id in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[node.id]
    if isinstance(node, ast.List):
        return [_python_value(x) for x in node.elts]
    if isinstance(node, ast.Dict):
        return {_python_value(k): _python_value(v) for k, v in zip(node.keys, node.values, strict=True)}
    return ast.literal_eval(node)


def _python_calls(text: str) -> list[tuple[str, str]]:
    try:
        body = ast.parse("[" + text + "]", mode="eval").body
        if not isinstance(body, ast.List) or not all(isinstance(c, ast.Call) and not c.args and all(k.arg for k in c.keywords) for c in body.elts):
            raise ValueError("no calls")
        return [(ast.unparse(c.func), _dump({k.arg: _python_value(k.value) for k in c.keywords})) for c in body.elts]
    except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
        raise ValueError("no calls") from None


def _object(value: object, key: str) -> tuple[str, str]:
    if not isinstance(value, dict) or not isinstance(value.get("name"), str) or key not in value:
        raise ValueError("no call")
    return value["name"], _dump(value[key])


def _kept(d: Dialect, texts: list[str], read: Callable[[str], tuple[str, str]]) -> list[tuple[str, str]]:
    out = []
    for t in texts:
        try:
            out.append(read(t))
        except ValueError:
            if d.strict:
                raise
    return out


def read(text: str, name: str) -> list[tuple[str, str]] | None:
    """The calls of a text in a dialect, arguments as JSON; null if it is no call. Where arguments have marks of their
    own, a value that is JSON is read as such, any other is a string."""
    d = DIALECTS[name]
    if len(text) > CHARS:
        return None
    try:
        match d.kind:
            case "action":
                found = [(n, a.strip().strip('"').strip("`")) for n, a in _ACTION.findall(text)]
                return [(n, _dump(_load(a))) for n, a in found] or None
            case "name":
                head, line, rest = text.partition("\n")
                return [(head, _dump(_load(rest)))] if line else None
            case "whole":
                value = _load(text)
                return [_object(v, d.arguments) for v in (value if isinstance(value, list) else [value])] or None
            case "lines":
                begin = text.find(d.open.strip())
                end = text.find(d.close.strip(), begin)
                if begin < 0 or end < 0:
                    return None
                return _kept(d, [x for x in text[begin + len(d.open.strip()) : end].splitlines() if x.strip()], lambda x: _object(_load(x), d.arguments))
            case "json":
                # a call ends before the next one or the text's end, so that its strings may hold the mark
                ends = r"(?=\s*<tool_call>|\s*\Z)" if d.strict else ""
                bodies = re.findall(_mark(d.open) + "(.*?)" + _mark(d.close) + ends, text, re.DOTALL)
                return _kept(d, bodies, lambda x: _object(_load(x), d.arguments)) or None
            case "tags":
                call, argument = _TAGS[name]
                if d.outer[0]:
                    inner = re.search(_mark(d.outer[0]) + "(.*?)" + _mark(d.outer[1]), text, re.DOTALL)
                    text = inner[1] if inner else ""
                out = []
                for c in call.finditer(text):
                    values = {}
                    for a in argument.finditer(c["body"]):
                        try:
                            values[a["key"]] = _load(a["value"].strip())
                        except ValueError:
                            values[a["key"]] = a["value"].strip() if d.strip else a["value"]
                    out.append((c["name"], _dump(values)))
                return out or None
            case "python":
                begin = text.find(d.open[:-1])
                end = text.find(d.close[1:], begin)
                inner = text[begin + len(d.open) - 1 : end].strip() if begin >= 0 and end >= 0 else ""
                return _python_calls(inner[1:-1] if inner.startswith("[") and inner.endswith("]") else inner) or None
        return _CHANNEL.findall(_THOUGHT.sub("", text)) or None
    except ValueError:
        return None


def read_with_rest(text: str, name: str) -> tuple[str, list[tuple[str, str]]]:
    """A reply without its calls, and the calls, as agents take them: of hermes and gpt_oss. Calls that can't be read go
    too; thoughts of gpt_oss go first, as they may hold what looks like calls."""
    if name == "hermes":
        return re.sub(r"(?s)<tool_call>.*?</tool_call>", "", text), read(text, name) or []
    if name == "gpt_oss":
        text = _THOUGHT.sub("", text)
        return _CHANNEL.sub("", text), read(text, name) or []
    raise ValueError(f"{name} is no dialect of agents")


def _dialect(name: Column | str) -> Column:
    if isinstance(name, str) and name not in DIALECTS:
        raise ValueError(f"unknown dialect {name}")
    return F.lit(name) if isinstance(name, str) else name


def formatted(calls: Column, dialect: Column | str) -> Column:
    """An array of calls (name, arguments) as text. Null calls or dialects give null, as does what ``written`` can't write."""

    def run(c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([written([(x["name"], x["arguments"]) for x in a], n) if a is not None and n in DIALECTS else None for a, n in zip(c, d, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(calls, _dialect(dialect))


def _rows(calls: list[tuple[str, str]]) -> list[dict]:
    return [{"name": n, "arguments": a} for n, a in calls]


def extracted(text: Column, dialect: Column | str) -> Column:
    """The calls of a text as an array of (name, arguments); null if the text is null or no call, or its dialect unknown."""

    def run(t: pd.Series, d: pd.Series) -> pd.Series:
        found = (read(x, n) if x is not None and n in DIALECTS else None for x, n in zip(t, d, strict=True))
        return pd.Series([None if f is None else _rows(f) for f in found], dtype=object)

    return F.pandas_udf(run, KIND)(text, _dialect(dialect))


def agent_turn(text: Column, dialect: str) -> Column:
    """(rest, calls) of a reply, as ``read_with_rest``; null texts give null."""
    if dialect not in ("hermes", "gpt_oss"):
        raise ValueError(f"{dialect} is no dialect of agents")

    def run(t: pd.Series) -> pd.Series:
        return pd.DataFrame([(None, None) if x is None else (lambda r: (r[0], _rows(r[1])))(read_with_rest(x, dialect)) for x in t], columns=["rest", "calls"], dtype=object)

    return F.pandas_udf(run, f"struct<rest:string,calls:{KIND}>")(text)
