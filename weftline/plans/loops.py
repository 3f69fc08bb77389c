"""Code metrics, iterative pipelines, reports and streams, bound to the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import codemetrics, steps
from weftline.operators import expansion
from weftline.plans.base import query, table
from weftline.plans.measures import rounded
from weftline.sources.shared import shared_folder
from weftline.streaming import streams


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small Python sources made of events, one in five without syntax."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    code = F.when(e % 5 == 0, F.concat(F.lit("def f(:\n  "), s(e))).otherwise(F.concat(F.lit("def total_"), s(e % 3), F.lit("(values):\n    result = "), s(e % 7), F.lit("\n    for v in values:\n        if v > "), s(e % 4), F.lit(" and v:  \n            result = result + v\n    return result\n")))
    return table(spark, sf_dir, "events").select("event_id", "event_type", code.alias("code"))


@query("SELECT event_id, event_id % 5 <> 0 AS parses, CASE WHEN event_id % 5 = 0 THEN 999 ELSE 4 END AS cyclomatic, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS nesting, 1 AS violations FROM events")
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sources(spark, sf_dir).select("event_id", codemetrics.metrics(F.col("code")).alias("m"))
    return m.select("event_id", "m.parses", "m.cyclomatic", "m.nesting", "m.violations")


@query()
def code_metrics_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sources(spark, sf_dir).select("event_id", codemetrics.metrics(F.col("code")).alias("m")).select("event_id", "m.*"))


@query("SELECT event_id, event_id % 5 <> 0 AS passes, round(CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE 1.0 END, 6) AS syntax_match FROM events")
def code_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.replace("code", F.lit("  \n"), F.lit("\n"))
    c = sources(spark, sf_dir).select("event_id", codemetrics.comparison(F.col("code"), after).alias("c"))
    return c.select("event_id", "c.passes", F.round("c.syntax_match", 6).alias("syntax_match"))


@query(
    """WITH t AS (SELECT l_linenumber % 3 AS k, l_quantity AS b, l_quantity + (l_partkey % 5 - 2) AS a, l_tax AS sb, l_discount AS sa, l_returnflag <> 'R' AS passes, l_linestatus = 'O' AS changed FROM lineitem)
SELECT k::BIGINT AS k, count(*) FILTER (passes AND changed AND CASE k WHEN 0 THEN a - b >= 0.01 WHEN 1 THEN sa >= 0.05 ELSE false END AND NOT (a - b < -1 OR (sa - sb < -0.05 AND sa < 0.05))) AS n_retained FROM t GROUP BY 1"""
)
def pareto_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gate with the match scaled by ten, as discounts stand for it."""
    p = F.col("l_linenumber") % 3
    df = table(spark, sf_dir, "lineitem").select(
        p.cast("long").alias("k"), F.when(p == 0, "style").when(p == 1, "syntax_match").otherwise("none").alias("primary"), F.col("l_quantity").alias("before_style"), (F.col("l_quantity") + (F.col("l_partkey") % 5 - 2)).alias("after_style"),
        (F.col("l_tax") * 10).alias("before_syntax_match"), F.round(F.col("l_discount") * 10, 6).alias("after_syntax_match"), (F.col("l_returnflag") != "R").alias("passes"), (F.col("l_linestatus") == "O").alias("changed"),
    )
    df = df.withColumn("before_syntax_match", F.round("before_syntax_match", 6))
    out = codemetrics.retained(df, "primary", "k", {"style": 0.01}, {"style": 1.0, "syntax_match": 0.5 + 1e-9}, ["style", "syntax_match"])
    return out.groupBy("k").agg(F.count_if("retained").alias("n_retained"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.concat(F.lit("Let x = "), (e % 9).cast("string"), F.lit("\nSo 2 + 3 = 5\nThen x + 5 is the answer"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", steps.split_steps(text).alias("steps"))


@query()
def expand_with_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expansion.expand_steps(_records(spark, sf_dir), "event_id", "steps")
    return out.select("event_id", F.size("nodes").alias("n_nodes"), "attempts", "kept", "accepted", F.round("best", 6).alias("best"), "error")


@query()
def expansion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    out = expansion.expand_steps(records, "event_id", "steps").join(records.select("event_id", "event_type"), "event_id")
    return rounded(expansion.batch_summary(out, "event_type"))


@query()
def rewrite_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(expansion.rewrite_code(sources(spark, sf_dir), "event_id", "code"))


@query(
    """SELECT s AS strategy, coalesce(n, 0) AS attempted, coalesce(k, 0) AS kept, round(CASE WHEN coalesce(n, 0) > 0 THEN k / n::DOUBLE ELSE 0 END, 6) AS rate
FROM (SELECT unnest(['click', 'error', 'view', 'never']) AS s) LEFT JOIN (SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS k FROM events GROUP BY 1) ON s = event_type"""
)
def method_retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), (F.col("event_id") % 3 == 0).alias("retained"))
    return rounded(expansion.retention_report(trace, ["click", "error", "view", "never"]))


@query("SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS attempt, count(*) AS n_attempts, min(event_id) FILTER (event_type = 'purchase') IS NOT NULL AS filled FROM events GROUP BY 1")
def rejection_sampling_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return expansion.first_valid(e, ["user_id"], "event_id", "ok")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension beside the inventory: event-time windows."""
    return streams.windowed(table(spark, sf_dir, "events"), "ts", "1 hour")


@query("SELECT event_id FROM events WHERE event_id >= (SELECT max(event_id) FROM events) - 50")
def fresh_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.fresh(table(spark, sf_dir, "events").select("event_id"), "event_id", 50)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_append_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the table's file, appended as JSON lines and read again."""
    out = f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    stream = streams.file_stream(spark, f"{sf_dir}/events.parquet*", events.schema).select("event_id", "user_id", "event_type")
    streams.append_trace(stream, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").json(f"{out}/data")
