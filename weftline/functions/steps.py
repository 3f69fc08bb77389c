"""Reasoning steps of a solution: splitting, kinds, formulas, structure, similarity, equations."""

from __future__ import annotations

import ast
import difflib
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let

_STRIP = r"^\s+|\s+$"


def _clean(x: Column) -> Column:
    return F.regexp_replace(x, _STRIP, "")


def split_steps(text: Column) -> Column:
    """Lines without numbering and bullets if there are two or more, else sentences. Null and blank texts: none.

    Abbreviations (e.g., i.e.) do not end a sentence, and words that hold their letters stay as they are.
    """

    def body(t: Column) -> Column:
        bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*(?:step\s*)?\d+[).:-]\s*", ""), r"^\s*[-*]\s*", "")
        lines = F.filter(F.transform(F.filter(F.transform(F.split(t, "\n"), _clean), lambda x: x != ""), bare), lambda x: x != "")
        safe = F.replace(F.replace(t, F.lit("e.g."), F.lit("e\x01g\x01")), F.lit("i.e."), F.lit("i\x01e\x01"))
        marked = F.regexp_replace(F.regexp_replace(safe, r"([.!?])\s+", "$1\x02"), r"(。)\s*", "$1\x02")
        sentences = F.filter(F.transform(F.split(marked, "\x02"), _clean), lambda x: x != "")
        whole = F.transform(sentences, lambda x: F.replace(x, F.lit("\x01"), F.lit(".")))
        return let(lines, lambda a: F.when(F.size(a) >= 2, a).otherwise(whole))

    t = _clean(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    return let(t, body)


def step_kind(step: Column, place: Column, total: Column) -> Column:
    low = F.lower(step)
    has = lambda *ws: low.rlike("|".join(ws))
    return (
        F.when((place == total) | has("answer", "therefore", "boxed"), "conclusion").when(has("let ", "define", "suppose", "assume"), "definition")
        .when(F.contains(step, F.lit("=")) & step.rlike(r"[+\-*/^]"), "equation_transform").when(has("so", "thus", "hence", "because"), "inference").otherwise("explanation")
    )


def adapter_kind(step: Column, place: Column, total: Column) -> Column:
    low = F.lower(step)
    return (
        F.when((place == 1) & low.rlike("let|given|there are|已知"), "key_definition").when((place == total) | low.rlike("answer|therefore|所以"), "final_answer")
        .when(F.contains(step, F.lit("=")) & step.rlike(r"[+\-*/^]"), "intermediate_calculation").otherwise("explanation_bridge")
    )


def formulas(text: Column) -> Column:
    """Runs of formula characters that hold an operator."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9().\s+\-*/^=<>]+)"), F.lit(1))
    return F.filter(F.transform(runs, _clean), lambda x: x.rlike(r"[=+\-*/^]"))


def structure_issues(text: Column) -> Column:
    """Unbalanced display and inline delimiters, and an odd number of double dollars."""
    n = lambda part: ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")
    return (n("\\[") != n("\\]")).cast("int") + (n("\\(") != n("\\)")).cast("int") + (n("$$") % 2).cast("int")


def unfenced(text: Column) -> Column:
    """The first fenced block's body, or the text."""
    found = F.regexp_extract(text, r"(?is)```(?:[a-z]+)?\s*\n?(.*?)```", 1)
    return F.trim(F.when(found != "", found).otherwise(text))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings, 0 if one is null; by Arrow batches."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() if p is not None and q is not None else 0.0 for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_SIGNS = {ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluate(expression: str) -> float | None:
    """The value of plain arithmetic; None if it is anything else. Powers above 64 are not computed."""

    def walk(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and type(node.op) in _SIGNS:
            return _SIGNS[type(node.op)](walk(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            x, y = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Pow) and (abs(y) > 64 or abs(x) > 1e6):
                raise ValueError("too large")
            return _OPERATORS[type(node.op)](x, y)
        raise ValueError("not arithmetic")

    text = re.sub(r"(\d)\s*(?=[A-Za-z(])", r"\1*", expression.replace("^", "**").strip())
    try:
        value = walk(ast.parse(text, mode="eval").body)
        return float(value) if not isinstance(value, complex) else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def consistent(equation: str | None) -> bool | None:
    """Whether all sides of an equation have one value, to 1e-6; None if a side has none."""
    sides = [evaluate(x) for x in (equation or "").split("=")]
    if len(sides) < 2 or any(x is None for x in sides):
        return None
    return all(abs(x - sides[0]) <= 1e-6 for x in sides[1:])


def equation_holds(equation: Column) -> Column:
    """``consistent`` of a column, by Arrow batches."""

    def run(equations: pd.Series) -> pd.Series:
        return pd.Series([consistent(e) for e in equations], dtype="object")

    return F.pandas_udf(run, "boolean")(equation)


def assignments(text: Column) -> Column:
    """name -> number of every ``name = number`` in a text, the last one of a name."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z]\w*)\s*=\s*(-?\d+(?:\.\d+)?)"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(r"([A-Za-z]\w*)\s*=\s*(-?\d+(?:\.\d+)?)"), F.lit(2))
    return F.map_from_entries(F.filter(F.arrays_zip(names.alias("n"), numbers.alias("v")), lambda x: x["n"].isNotNull()))
