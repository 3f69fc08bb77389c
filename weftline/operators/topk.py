"""Comparison of two token distributions given by their k likeliest tokens.

Rows are tokens with arrays of (id, student, teacher): ``s`` the student's k ids with both log-probabilities, ``t`` the
teacher's. All work stays inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.binding import let

STRATEGIES = ("only_stu", "only_tch", "intersection", "union", "union_intersection")


def _ids(x: Column) -> Column:
    return F.transform(x, lambda e: e["id"])


def overlap(s: Column, t: Column) -> Column:
    """Ids of the student's that are among the teacher's."""
    return F.size(F.array_intersect(_ids(s), _ids(t)))


def chosen(s: Column, t: Column, strategy: str) -> Column:
    """The entries that a strategy compares."""
    outside = lambda x, y: let(_ids(y), lambda ids: F.filter(x, lambda e: ~F.array_contains(ids, e["id"])))
    if strategy == "only_stu":
        return s
    if strategy == "only_tch":
        return t
    if strategy == "intersection":
        return let(_ids(t), lambda ids: F.filter(s, lambda e: F.array_contains(ids, e["id"])))
    if strategy == "union":
        return F.concat(s, outside(t, s))
    if strategy == "union_intersection":
        return F.concat(outside(s, t), outside(t, s))
    raise ValueError(f"unknown strategy {strategy}")


def weighted_reward(s: Column, t: Column, strategy: str, weight: str = "student_p") -> Column:
    """Sum over the chosen entries of -(student - teacher) times a weight.

    Weights are a softmax of the student's or the teacher's log-probabilities (or equal) over the entries, but plain
    probabilities for ``union_intersection``. No entries give 0. The entries are found once.
    """
    score = {"student_p": lambda e: e["student"], "teacher_p": lambda e: e["teacher"], "none": lambda e: F.lit(0.0)}[weight]

    def reward(x: Column) -> Column:
        total = F.lit(1.0) if strategy == "union_intersection" else F.aggregate(x, F.lit(0.0), lambda a, e: a + F.exp(score(e)))
        gain = F.aggregate(x, F.lit(0.0), lambda a, e: a - (e["student"] - e["teacher"]) * F.exp(score(e)))
        return F.when(F.size(x) > 0, gain / total).otherwise(0.0)

    return let(chosen(s, t, strategy), reward)


def probabilities(logs: Column, keys: Column) -> Column:
    """The softmax over ``keys`` of a map of log-probabilities; keys that it lacks get its least value less 20."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    raised = lambda floor: F.transform(keys, lambda k: F.exp(F.coalesce(F.try_element_at(logs, k), floor)))
    shares = lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(F.array_min(F.map_values(logs)) - 20.0, lambda floor: let(raised(floor), shares))


def kl_tv(student: Column, teacher: Column) -> Column:
    """(kl, tv): divergence of the teacher from the student (at least 0) and total variation, of two maps over all their
    keys. Each softmax is computed once."""

    def compare(b: Column) -> Column:
        kl = F.aggregate(F.zip_with(b["p"], b["q"], lambda x, y: y * F.ln(y / F.greatest(x, F.lit(1e-12)))), F.lit(0.0), lambda a, x: a + x)
        tv = F.aggregate(F.zip_with(b["p"], b["q"], lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) * 0.5
        return F.struct(F.greatest(kl, F.lit(0.0)).alias("kl"), F.least(F.greatest(tv, F.lit(0.0)), F.lit(1.0)).alias("tv"))

    keys = F.array_sort(F.array_union(F.map_keys(student), F.map_keys(teacher)))
    both = lambda k: F.struct(probabilities(student, k).alias("p"), probabilities(teacher, k).alias("q"))
    return let(let(keys, both), compare)


def by_aspect(df: DataFrame, key: str, weights: str, metrics: list[str]) -> DataFrame:
    """Per key and aspect the metrics' means weighted by a map column; 0 without weight."""
    x = df.select(key, F.explode(weights).alias("aspect", "w"), *metrics)
    mean = lambda c: F.when(F.sum("w") > 0, F.sum(F.col(c) * F.col("w")) / F.sum("w")).otherwise(0.0)
    return x.groupBy(key, "aspect").agg(*(mean(c).alias(c) for c in metrics), F.sum("w").alias("weight"))
