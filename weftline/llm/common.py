"""Shared helpers: table access, byte-bounded Arrow batches, sizes and checkpoints."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one step of a Python operator holds at a time; a longer text makes a step of its own.
STEP_BYTES = 2 << 20
#: Rows of a step, however short their texts.
STEP_ROWS = 50_000

#: The C library, if it can trim its heap.
_LIBC = next((c for c in [ctypes.CDLL(ctypes.util.find_library("c"))] if hasattr(c, "malloc_trim")), None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer by underscores if a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes at most, or one row, and STEP_ROWS at most."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit or i - begin == STEP_ROWS:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """The bytes of the texts of all rows. It sets numbers of groups, nothing else."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def give_back() -> None:
    """Returns freed memory to the system; Python workers live on between tasks and stages, and so would it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def gathered(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df`` in no more tasks than its rows need: small results then shuffle and write few files. No limit on rows."""
    return df.coalesce(max(1, -(-rows // per_task)))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. Only a local session without one, as in tests, gets
    a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; a folder is set only where the session has none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
