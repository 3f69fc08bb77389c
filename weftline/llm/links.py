"""Connected components of links, by repeated joins; nothing of a graph is ever on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, gathered


def components(edges: DataFrame) -> DataFrame:
    """(id, class_id) of every end of ``edges`` (a, b): class_id is the smallest id that it is linked to over any
    number of links. Each round takes the smallest label among neighbours, then the label's own label; it ends when
    no label changes. Null ends take no part; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    n = 2 * edges.count()
    few = lambda df: gathered(df, n)
    both = checkpointed(few(few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))).distinct()))
    label = checkpointed(few(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id"))))
    while True:
        near = few(both.join(label.select(F.col("id").alias("b"), "class_id"), "b")).groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        met = few(label.join(near, "id")).select("id", F.col("class_id").alias("old"), F.least("class_id", "near").alias("class_id"))
        jump = label.select(F.col("id").alias("class_id"), F.col("class_id").alias("further"))
        # every class_id is an end of an edge, so it has a label
        new = checkpointed(few(met.join(jump, "class_id").select("id", F.least("class_id", "further").alias("class_id"), "old")))
        changed = new.where("class_id <> old").limit(1).count()
        label = new.select("id", "class_id")
        if not changed:
            return label
