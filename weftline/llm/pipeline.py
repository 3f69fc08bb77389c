"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import minhash, packing, privacy, quality, repeats
from weftline.llm.common import shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5. The classifier learns from the labelled rows of ``docs`` outside
    the held-out third; null, empty and very long texts, repeated rows and rows without an id are scored like any
    other; without labels all score 0.5 and stay. Columns of any name are kept; no rows give no rows."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id. Rows with a null id all stay, as do
    all rows that repeat a kept doc_id; texts without words (null, empty) are one class by themselves. Columns of any
    name are kept; no rows give no rows."""
    return minhash.without_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that a document of a smaller doc_id has too. Null, empty and short texts stay,
    as do all rows, repeated ones among them; columns of any name are kept; no rows give no rows."""
    return repeats.without_repeats(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised and the terms removed that reveal it. Null and empty texts stay, as do all
    rows, which change alike if they are repeated; columns of any name are kept; no rows give no rows."""
    return privacy.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequences and places. Null and empty texts are one id; every row
    is packed, repeated ones too; of the columns only doc_id and text count; no rows give no rows."""
    return packing.pack(docs, *packing.default_paths())


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicate classes", keep_one_of_each_class),
    ("repeated passages", drop_repeats),
    ("personal data", hide_personal_data),
    ("packing", pack_sequences),
]

#: A learned score, signatures and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages are written to the shared folder that spark.checkpoint.dir names."""
    home = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
    return docs
