"""Queries of custom datasets and of controllers with state, and the SQL that states the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.base import query, table
from weftline.sources import custom
from weftline.sources.shared import shared_folder
from weftline.streaming import control


def shortened(df: DataFrame, words: int) -> DataFrame:
    """A generator: the first words of each text as a new document, under the negative of its id less one."""
    return df.select((-F.col("doc_id") - 1).alias("doc_id"), F.array_join(F.slice(F.split("text", " "), 1, words), " ").alias("text"), "lang")


@query("SELECT event_id, user_id, event_type, value FROM events")
def custom_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events by the source of custom datasets, in ranges of rows."""
    return custom.read_dataset(spark, "weftline.sources.custom:ParquetRows", path=f"{sf_dir}/events.parquet", columns="event_id, user_id, event_type, value", rowsPerTask=20_000)


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def custom_dataset_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same source as a stream, written to the shared folder until what is there has been taken."""
    out = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    stream = custom.stream_dataset(spark, "weftline.sources.custom:ParquetRows", path=f"{sf_dir}/events.parquet", columns="event_id, user_id", rowsPerTask=20_000)
    stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT doc_id, text, lang FROM documents UNION ALL SELECT -doc_id - 1, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' '), lang FROM documents")
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom.with_generated(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "weftline.plans.feeds:shortened", words=5)


_STEPS = "SELECT event_type AS run, event_id // 100 AS step, avg(value) / 1000 AS divergence, count(*) AS n FROM events GROUP BY 1, 2"


@query(
    f"""SELECT run, step, round(0.2 * coalesce(product(1 + greatest(least(divergence / 0.1 - 1, 0.2), -0.2) * n / 10000) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 9) AS coefficient
FROM ({_STEPS})"""
)
def adaptive_kl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of three spans of time arrive as three files; a stream takes one a batch and keeps each run's coefficient."""
    out = f"{shared_folder(spark)}/control-{uuid.uuid4().hex}"
    steps = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.expr("event_id div 100").alias("step")).agg((F.avg("value") / 1000).alias("divergence"), F.count("*").alias("n"))
    last = steps.agg(F.max("step")).first()[0] or 0
    for i in range(3):
        span = (F.col("step") > i * last // 3 - (i == 0)) & (F.col("step") <= (i + 1) * last // 3)
        steps.where(span).coalesce(1).write.mode("append").parquet(f"{out}/steps")
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/steps")
    held = control.adaptive_coefficients(stream, 0.2, 0.1, 10_000)
    held.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").select("run", "step", F.round("coefficient", 9).alias("coefficient"))


@query(
    f"""WITH c AS (SELECT run, step, 0.2 * coalesce(product(1 + greatest(least(divergence / 0.1 - 1, 0.2), -0.2) * n / 10000) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS coefficient FROM ({_STEPS}))
SELECT event_id, round(user_id - coefficient * value / 1000, 6) AS reward FROM events JOIN c ON run = event_type AND step = event_id // 100"""
)
def adaptive_kl_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards less the divergence at the coefficient of their step, of the whole table at once."""
    tokens = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("run"), F.expr("event_id div 100").alias("step"), F.col("user_id").cast("double").alias("score"), (F.col("value") / 1000).alias("kl"))
    steps = tokens.groupBy("run", "step").agg(F.avg("kl").alias("divergence"), F.count("*").alias("n"))
    out = control.penalised(tokens, control.coefficients_of(steps, 0.2, 0.1, 10_000))
    return out.select("event_id", F.round("reward", 6).alias("reward"))
