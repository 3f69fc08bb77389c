"""Converters of datasets to one form, by the name of their format: (system, prompt, response, chosen first) messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import finetune

#: Makes (system, prompt, response) Columns of the columns of a table, which the mapping names by their role.
Converter = Callable[[Callable[[str], Column | None]], tuple[Column, Column, Column]]
CONVERTERS: dict[str, Converter] = {}


def converter(name: str) -> Callable[[Converter], Converter]:
    """Registers a converter; a name is given once."""

    def register(f: Converter) -> Converter:
        if name in CONVERTERS:
            raise ValueError(f"converter {name} is registered already")
        CONVERTERS[name] = f
        return f

    return register


def converted(df: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with ``_system``, ``_prompt`` and ``_response``. ``columns`` gives the column of each role that the format
    knows; roles without a column are absent. An unknown format is refused, and so is a column that ``df`` lacks."""
    if name not in CONVERTERS:
        raise ValueError(f"no converter {name}; known are {', '.join(sorted(CONVERTERS))}")
    missing = sorted(set(columns.values()) - set(df.columns))
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    system, prompt, response = CONVERTERS[name](lambda role: F.col(columns[role]) if role in columns else None)
    return df.withColumns({"_system": system, "_prompt": prompt, "_response": response})


@converter("alpaca")
def _alpaca(of) -> tuple[Column, Column, Column]:
    """Roles prompt, query, response or (chosen, rejected) or (response, tag), system, history."""
    prompt, response, system = finetune.align_alpaca(of("prompt"), of("query"), of("response"), of("system"), of("history"))
    if of("chosen") is not None and of("rejected") is not None:
        response = finetune.align_pair(of("chosen"), of("rejected"))
    elif of("tag") is not None:
        response = finetune.align_tagged(of("response"), of("tag"))
    return system, prompt, response


@converter("sharegpt")
def _sharegpt(of) -> tuple[Column, Column, Column]:
    """Roles messages (array of ``from``, ``value``) with the usual tags, system."""
    # The tags of shared chats and the roles that they stand for; others stay as they are.
    roles = {"human": "user", "gpt": "assistant", "observation": "observation", "function_call": "function", "system": "system"}
    named = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
    turns = F.transform(of("messages"), lambda m: F.struct(F.coalesce(F.element_at(named, m["from"]), m["from"]).alias("role"), m["value"].alias("content")))
    return _chat(turns, of("system"))


@converter("openai")
def _openai(of) -> tuple[Column, Column, Column]:
    """Roles messages (array of ``role``, ``content``), system."""
    return _chat(of("messages"), of("system"))


def _chat(turns: Column, system: Column | None) -> tuple[Column, Column, Column]:
    own, prompt, response = finetune.align_chat(turns)
    return F.when(own != "", own).otherwise(F.coalesce(system, F.lit(""))) if system is not None else own, prompt, response
