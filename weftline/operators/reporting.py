"""Reports over runs: metrics before and after, what passed, sizes of traces. One aggregate each, no pivot by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_changes(df: DataFrame, before: Column, after: Column, field: str = "score") -> DataFrame:
    """name, before, after, delta: the mean of each metric in two arrays of structs (name and ``field``) over all rows.

    A name that only one side has counts as 0 on the other; null values and null names are not counted, so a metric
    with null values alone has no row.
    """
    each = df.select(F.explode(F.array(F.struct(F.lit(True).alias("late"), after.alias("m")), F.struct(F.lit(False).alias("late"), before.alias("m")))).alias("x"))
    flat = each.select("x.late", F.explode("x.m").alias("m")).select("late", "m.name", F.col(f"m.{field}").cast("double").alias("v")).where(F.col("name").isNotNull() & F.col("v").isNotNull())
    mean = lambda late: F.coalesce(F.avg(F.when(F.col("late") == F.lit(late), F.col("v"))), F.lit(0.0))
    out = flat.groupBy("name").agg(mean(False).alias("before"), mean(True).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before"))


def execution_rates(df: DataFrame, passed: Column, pass_rate: Column, candidates: Column) -> DataFrame:
    """One row: the share of records whose final output passed, the mean of its rates of passed tests (records without
    one aside), the same two over candidates (array of structs ``passed``, ``pass_rate``), and their number. A
    candidate without a rate counts as 0; without records or candidates the shares are 0."""
    share = lambda c: F.coalesce(c, F.lit(0.0))
    hit = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    own = df.select(
        hit(passed).alias("p"), pass_rate.cast("double").alias("r"), F.coalesce(F.size(candidates), F.lit(0)).alias("n"),
        F.aggregate(F.coalesce(candidates, F.array()), F.struct(F.lit(0).cast("long").alias("p"), F.lit(0.0).alias("r")),
                    lambda a, x: F.struct((a["p"] + hit(x["passed"])).alias("p"), (a["r"] + F.coalesce(x["pass_rate"].cast("double"), F.lit(0.0))).alias("r"))).alias("c"),
    ).withColumn("n", F.greatest("n", F.lit(0)))
    return own.agg(
        share(F.avg("p")).alias("final_pass_rate"), share(F.avg("r")).alias("final_test_rate"), share(F.sum("c.p") / F.nullif(F.sum("n"), F.lit(0))).alias("candidate_pass_rate"),
        share(F.sum("c.r") / F.nullif(F.sum("n"), F.lit(0))).alias("candidate_test_rate"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("candidates"),
    )


def totals(df: DataFrame, group: str, before: Column, after: Column) -> DataFrame:
    """Sizes before and after, and what was added (0 at least), for each group and in all (ALL). Null sizes count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = df.rollup(group).agg(F.grouping(group).alias("_g"), total(before).alias("before"), total(after).alias("after"))
    return out.withColumn("added", F.greatest(F.col("after") - F.col("before"), F.lit(0))).withColumn(group, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(group).cast("string"))).drop("_g")


def retained_share(trace: DataFrame, tried: Column, retained: Column) -> DataFrame:
    """One row: of the attempts of known strategies those that were retained; without attempts 0."""
    return trace.agg(F.coalesce(F.count_if(tried & retained) / F.nullif(F.count_if(tried), F.lit(0)), F.lit(0.0)).alias("rate"))
