"""Readers and writers: tables by extension, JSON lines strict and lenient, CSV, Parquet, a registry of datasets."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text", "orc": "orc"}


def extension(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()


def read(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Files of one format, which their extension names; mixed ones are refused."""
    paths = [paths] if isinstance(paths, str) else paths
    kinds = {extension(p) for p in paths}
    if len(kinds) != 1 or not kinds <= FORMATS.keys():
        raise ValueError(f"files of one known format are asked for, got {', '.join(sorted(kinds))}")
    kind = FORMATS[kinds.pop()]
    reader = spark.read.schema(schema) if schema is not None and kind != "text" else spark.read
    if kind == "csv":
        reader = reader.option("header", True) if schema is not None else reader.option("header", True).option("inferSchema", True)
    return reader.format(kind).load(paths)


def read_folder(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.json*") -> DataFrame:
    """JSON and JSON-lines files of a folder in any store that Spark reads (s3a://, gs://, hdfs://, file)."""
    return spark.read.schema(schema).option("pathGlobFilter", pattern).json(folder)


def hyper_parameters(path: Column, pattern: str) -> Column:
    """The named groups of a pattern in a file's path, by name; a path without a match has none."""
    names = re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern)
    entries = [F.struct(F.lit(n).alias("key"), F.regexp_extract(path, pattern, i + 1).alias("value")) for i, n in enumerate(names)]
    return F.when(path.rlike(pattern), F.map_from_entries(F.array(*entries)))


def append_rows(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The Parquet table at ``path`` with new rows, for the next epoch: written beside the old ones, and read again."""
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def save_batch(df: DataFrame, path: str, meta: dict) -> None:
    """A batch with what describes it: rows as Parquet, the description as one line of JSON beside them."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without a byte order mark and blank ones, in the order of the files' names and of the lines in them, however
    Spark lists and splits the files."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    df = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"), place.alias("line_order"))
    return df.where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, limit: int = 0) -> DataFrame:
    """Records of JSON lines. Strict: a malformed line fails the job and is quoted; else such lines are left out.
    ``limit`` takes the first records, 0 or less all."""
    kind = T._parse_datatype_string(schema)
    probe = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = _lines(spark, path).select("line_order", "value", F.from_json("value", probe, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if strict:
        check = F.when(bad, F.raise_error(F.concat(F.lit("malformed line in "), F.col("line_order.file_path"), F.lit(": "), F.substring("value", 1, 200))).cast("boolean")).otherwise(True)
        parsed = parsed.where(check)
    else:
        parsed = parsed.where(~bad)
    if limit > 0:
        parsed = parsed.orderBy("line_order").limit(limit)
    return parsed.select(*(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields))


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_number from 1, value) of the lines that are no record; blank lines are counted and are no error.

    Lines of a file are numbered range by range, so a file of any size is split. A strict read that fails says which
    file to ask for.
    """
    from weftline.operators.batch import before_within

    kind = T._parse_datatype_string(schema)
    probe = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    placed = before_within(lines, "file", ["_at", "_line"], F.lit(1), "_n")
    record = F.from_json("value", probe, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    bad = placed.where(F.trim("value") != "").withColumn("_r", record).where(F.col("_r").isNull() | F.col("_r._bad").isNotNull())
    return bad.select("file", (F.col("_n") + 1).alias("line_number"), "value")


def tail_jsonl(spark: SparkSession, path: str, schema: str, limit: int) -> DataFrame:
    """The last ``limit`` records that parse, in their order."""
    kind = T._parse_datatype_string(schema)
    parsed = _lines(spark, path).select("line_order", F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r").isNotNull())
    last = parsed.orderBy(F.desc("line_order")).limit(limit)
    return last.orderBy("line_order").select(*(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Snappy Parquet; an empty table is refused before anything is written."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def dump_step(df: DataFrame, path: str, step: int) -> None:
    """Generations of one training step, beside those of others."""
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").json(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``, made by ``make()`` if it is not there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lies and what its columns are called."""

    path: str
    ranking: bool = False
    columns: dict[str, str] = field(default_factory=dict)


class Registry:
    """Datasets by name, from JSON: {"name": {"file_name": ..., "ranking": ..., "columns": {...}}}."""

    def __init__(self, text: str, home: str = ""):
        self.datasets = {k: Dataset(f"{home}/{v['file_name']}" if home else v["file_name"], bool(v.get("ranking")), v.get("columns", {})) for k, v in json.loads(text).items()}

    def get(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise ValueError(f"undefined dataset {name}")
        return self.datasets[name]

    def load(self, spark: SparkSession, name: str, ranking: bool | None = None) -> DataFrame:
        d = self.get(name)
        if ranking is not None and ranking != d.ranking:
            raise ValueError(f"dataset {name} is {'' if d.ranking else 'not '}a ranking dataset")
        df = read(spark, d.path)
        return df.withColumnsRenamed({old: new for new, old in d.columns.items() if old in df.columns})
