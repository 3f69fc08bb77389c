"""Replies and LaTeX answers: tables of cases."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import latex, replies


def values(spark, cases: list, column) -> list:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", column(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


NORMAL = {
    "": "", "\n": "", "\\frac12": "\\frac{1}{2}", "\\frac1{72}": "\\frac{1}{72}", "\\frac{72}1": "\\frac{72}1", "\\tfrac34 + \\dfrac{1}{2}": "\\frac{3}{4}+\\frac{1}{2}", "\\sqrt3": "\\sqrt{3}", "2\\sqrt{12}": "2\\sqrt{12}",
    "\\sqrt2+\\sqrt x": "\\sqrt{2}+\\sqrt{}x", "0.5": "\\frac{1}{2}", ".5": "\\frac{1}{2}", "k = 3": "3", "q=.5": ".5", "abc = 3": "abc=3", "a=b=c": "a=b=c", "3/4": "\\frac{3}{4}", "-3/4": "\\frac{-3}{4}", "03/4": "03/4", "x/y": "x/y", "1/2/3": "1/2/3",
    "5\\text{ cm}": "5", "50\\%": "50", "90^\\circ": "90", "90^{\\circ}": "90", "\\left(1,2\\right)": "(1,2)", "\\$12\\!,\\!000": "12,000", "\\{.25\\}": "\\{0.25\\}", "a .5": "a0.5", "\\frac1": "\\frac1", "1+\\frac1": "1+\\frac1",
    "\\text{ a}\\text{ b}": None, "\\sqrt": None, "\\frac": None, "\\frac\\frac12": None, None: None,
}


def test_normal_form(spark):
    assert dict(zip(NORMAL, values(spark, list(NORMAL), latex.normal_form), strict=True)) == NORMAL


def test_equivalence_and_score(spark):
    pairs = [("\\frac12", "0.5", True), ("1/2", "\\dfrac{1}{2}", True), ("\\frac", "\\frac", True), ("\\frac", "1", False), (None, None, True), (None, "1", False), ("2", "3", False)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, want boolean").withColumn("got", latex.equivalent(F.col("a"), F.col("b"))).collect()
    assert all(r.got == r.want for r in rows)
    texts = [("so \\boxed{1} or \\boxed{\\frac12}", "0.5", 1.0), ("\\boxed{3", "3", 0.0), ("3", "3", 0.0), ("\\boxed{\\text{ a}\\text{ b}}", "\\text{ a}\\text{ b}", 1.0), (None, "3", 0.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(texts)], "i int, a string, b string, want double").withColumn("got", latex.boxed_score(F.col("a"), F.col("b"))).collect()
    assert all(r.got == r.want for r in rows)


def test_short_forms_and_tuples(spark):
    short = {"\\text{Blue}": "blue", "12 cm^2": "12", "3 feet": "3", "\\$5 million": "5*10^6", "{7}": "7", "3.0": "3", "1,234": "1234", "2 1/2": "2+1/2", "x or y": "x,y", "45^\\circ": "45", "- 3": "-3", "1,\\! 000": "1000", "0.25": "0.25"}
    assert dict(zip(short, values(spark, list(short), latex.short_form), strict=True)) == short
    tuples = {"": [], "(1, 2)": ["1", "2"], "[1,000, 2)": ["1000", "2"], "1,234,567": ["1234567"], "(1,(2))": ["(1,(2))"], "1,2": ["1,2"], "()": ["()"], "(12,345)": ["12345"], "12,34": ["12,34"]}
    assert dict(zip(tuples, values(spark, list(tuples), latex.tuple_elements), strict=True)) == tuples


def test_adapter_steps(spark):
    cases = {
        "- Let x be 2.\n2) Then 3.\r\n$$\n\\begin{align}\n\\end{align}\n..\nx": ["Let x be 2.", "Then 3.", "x"], "One. Two! Three": ["One.", "Two!", "Three"], "$$": ["$$"], " \n ": [], None: [], "3：算": ["3：算"], "a": ["a"], "好。  再见": ["好。", "再见"],
    }
    assert list(cases.values()) == values(spark, list(cases), replies.adapter_steps)


def test_clause_formulas(spark):
    cases = {"Thus the total is x + 2 = 5, so we get y=3*4. Done": ["x + 2 = 5", "y=3*4"], "no operators here": [], "": [], "we have 2^3 = 8; 4/2": ["2^3 = 8", "4/2"], "x  +\n1": ["x + 1"]}
    assert list(cases.values()) == values(spark, list(cases), replies.clause_formulas)


def test_reply_steps(spark):
    cases = {
        '{"steps": [" a ", "", "b"]}': ["a", "b"], '{"other": 1}': [], 'text\n```json\n{"steps": ["c"]}\n```\nmore': ["c"], "```\n- x\n2. y\n```": ["x", "y"], "1) one\n\n* two": ["one", "two"], "": [""], '{"steps": [1, 2]}': ["1", "2"], "{broken": ["{broken"],
    }
    assert list(cases.values()) == values(spark, list(cases), replies.reply_steps)


def test_reply_rewrite(spark):
    note = "Parsed from non-JSON model response."
    cases = {
        json.dumps({"code": " x = 1 ", "reasoning": ["r"], "rationale": "why"}): ("x = 1", ["r"], "why"), '{"code": "y"}': ("y", [], ""), "plain code": ("plain code", [], note),
        'say\n```json\n{"code": "z"}\n```': ("z", [], ""), "```\nq = 2\n```": ("q = 2", [], note),
    }
    assert list(cases.values()) == [tuple(v) for v in values(spark, list(cases), replies.reply_rewrite)]


def test_feedback(spark):
    full = {"preserve": ["a", " "], "fix": "one", "avoid": [], "evidence": ["e", "f"]}
    other = {"preserve": F.array(F.lit("p"), F.lit("")), "fix": F.array(F.lit("q"))}
    cases = {json.dumps(full): (["a"], ["one"], [], ["e", "f"]), json.dumps({"preserve": ["a"]}): (["p"], ["q"], [], []), "no json": (["p"], ["q"], [], []), "": (["p"], ["q"], [], [])}
    assert list(cases.values()) == [tuple(v) for v in values(spark, list(cases), lambda t: replies.feedback(t, other))]


def test_fallback_scores(spark):
    got = values(spark, ["we find that x = 3 here", "short", ""], replies.fallback_scores)
    assert [round(v.aggregate_score, 6) for v in got] == [pytest.approx(0.18 * 0.82 + 0.24 * 0.78 + 0.24 * 0.85 + 0.17 * 0.8 + 0.17 * 0.68), pytest.approx(0.18 * 0.82 + 0.24 * 0.78 + 0.24 * 0.65 + 0.17 * 0.55 + 0.17 * 0.45), pytest.approx(0.18 * 0.82 + 0.24 * 0.65 + 0.17 * 0.55 + 0.17 * 0.45)]
    assert [v.accepted for v in got] == [True, True, False]


def test_agreement(spark):
    cases = [
        ("\\frac12", "0.5", True), ("50\\%", "0.5", True), ("3 feet", "3", True), ("1,000", "1000", True), ("-\\frac{3}{4}", "-0.75", True), ("2 1/2", "2.5", True), ("\\frac{1}{3}", "0.3333", False),
        ("(1, \\frac12)", "(1,0.5)", True), ("(1,2]", "(1,2)", False), ("(1,2)", "(1,3)", False), ("x+1", "1+x", False), ("x+1", "x + 1", True), (None, "1", False), ("1/0", "1", False),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want boolean").withColumn("got", latex.agrees(F.col("a"), F.col("b"))).collect()
    assert [(r.a, r.b) for r in rows if r.got != r.want] == []
