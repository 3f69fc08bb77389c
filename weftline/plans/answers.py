"""Queries of answers with unknowns and of trees, and the SQL that states the same by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import symbolic, trees
from weftline.operators.batch import spread
from weftline.plans.base import query, table

_A, _B, _C = "l_linenumber", "(l_partkey % 9 + 1)", "CAST(l_quantity AS INT)"
#: A truth and an answer with the numbers of a line, and the condition under which they are the same expression.
_FORMS = [
    (["{a}", "(x+", "{b}", ")"], ["{a}", "x+", "{c}"], "{c} = {a} * {b}"),
    (["x+", "{b}"], ["\\frac", "{{", "x^2-", "{c}", "}}", "{{", "x-", "{b}", "}}"], "{c} = {b} * {b}"),
    (["\\sqrt", "{{", "{c}", "}}"], ["{a}", "\\sqrt", "{{", "{b}", "}}"], "{c} = {a} * {a} * {b}"),
    (["\\left(x-", "{a}", "\\right)(x+", "{b}", ")"], ["x^2+", "{c}", "x-", "{a}", "\\cdot ", "{b}"], "{c} = {b} - {a}"),
    (["\\frac", "{a}", "{b}", "x"], ["\\dfrac", "{{", "{c}", " x", "}}", "{{", "{a}", "*", "{b}", "}}"], "{c} = {a} * {a}"),
    (["2^", "{{", "{a}", "+n", "}}"], ["{c}", "\\cdot 2^n"], "{c} = power(2, {a})"),
]


def _text(parts: list[str]) -> str:
    """SQL that joins literal parts and numbers."""
    numbers = {"{a}": _A, "{b}": _B, "{c}": _C}
    return " || ".join(f"CAST({numbers[p]} AS VARCHAR)" if p in numbers else "'" + p.replace("{{", "{").replace("}}", "}") + "'" for p in parts)


_CASE = "CASE l_suppkey % 6 " + " ".join("WHEN {} THEN {{}}".format(i) for i in range(len(_FORMS))) + " END"
_TRUTH, _GIVEN = (_CASE.format(*(_text(f[k]) for f in _FORMS)) for k in (0, 1))
_EQUAL = _CASE.format(*(f[2].format(a=_A, b=_B, c=_C) for f in _FORMS))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_TRUTH} AS truth, {_GIVEN} AS answer, {_EQUAL} AS same FROM lineitem")
def symbolic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six families of answers with unknowns; whether one equals its truth depends on the line's numbers."""
    spark_sql = lambda s: F.expr(s.replace("\\", "\\\\").replace("VARCHAR", "STRING"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", spark_sql(_TRUTH).alias("truth"), spark_sql(_GIVEN).alias("answer"))
    return lines.withColumn("same", symbolic.symbolically_equal(F.col("answer"), F.col("truth")))


@query(f"SELECT l_suppkey % 6 AS family, count(*) AS answers, count(*) FILTER (WHERE {_EQUAL}) AS correct FROM lineitem GROUP BY 1")
def graded_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers of each family by the whole way of grading."""
    spark_sql = lambda s: F.expr(s.replace("\\", "\\\\").replace("VARCHAR", "STRING"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).alias("family"), spark_sql(_TRUTH).alias("truth"), spark_sql(_GIVEN).alias("answer"))
    # equal answers to one truth are graded once
    pairs = spread(lines.groupBy("family", "truth", "answer").agg(F.count("*").alias("n"))).withColumn("ok", symbolic.grade(F.col("answer"), F.col("truth")))
    return pairs.groupBy("family").agg(F.sum("n").alias("answers"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("correct"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance, abs(length(p_name) - length(p_type))::BIGINT AS to_chain FROM part")
def tree_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees whose distance SQL can state: letters below one root differ as strings do, and chains of one label by their lengths."""
    letters = lambda c: F.split(c, "")
    below = lambda n: F.concat(F.array(F.lit(-1)), F.array_repeat(F.lit(0), n))
    star = lambda c: F.struct(F.concat(F.array(F.lit("")), letters(c)).alias("labels"), below(F.length(c)).alias("parents"))
    chain = lambda c: F.struct(F.array_repeat(F.lit("n"), F.length(c)).alias("labels"), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: i - 2).alias("parents"))
    p = spread(table(spark, sf_dir, "part")).select("p_partkey", star(F.col("p_name")).alias("a"), star(F.col("p_type")).alias("b"), chain(F.col("p_name")).alias("x"), chain(F.col("p_type")).alias("y"))
    d = p.withColumn("distance", trees.tree_distance(F.col("a"), F.col("b"))).withColumn("to_chain", trees.tree_distance(F.col("x"), F.col("y")))
    return d.select("p_partkey", "distance", "to_chain")
