"""Custom datasets: a class of rows by number is a Spark source, read in ranges as a batch and by offsets as a stream.

A dataset is a class made with the options of the read. It has ``schema()``, ``count()`` and ``rows(start, stop)``,
which yields tuples or Arrow batches of the rows from ``start`` to ``stop``. Rows keep their numbers; new ones come
after the old ones.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Rows of one task, if the option rowsPerTask doesn't say otherwise.
ROWS_PER_TASK = 50_000
NAME = "weftline_dataset"


class Dataset(Protocol):
    def schema(self) -> str: ...

    def count(self) -> int: ...

    def rows(self, start: int, stop: int) -> Iterator[tuple | pa.RecordBatch]: ...


def load(place: str) -> Callable:
    """A class or function by ``package.module:name`` or ``/path/file.py:name``. Workers load it too, so a file has to
    be in a folder that all machines share, or on their path."""
    module, _, name = place.rpartition(":")
    if not module or not name:
        raise ValueError(f"module:name is asked for, got {place}")
    if module.endswith(".py"):
        spec = importlib.util.spec_from_file_location("custom_dataset", module)
        if spec is None or spec.loader is None:
            raise FileNotFoundError(module)
        found = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(found)
    else:
        found = importlib.import_module(module)
    if not hasattr(found, name):
        raise AttributeError(f"{module} has no {name}")
    return getattr(found, name)


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reads:
    """What batch and stream readers share. Options' names come in lower case."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.step = int(self.options.get("rowspertask", ROWS_PER_TASK))
        if self.step < 1:
            raise ValueError("rowsPerTask has to be at least 1")

    def dataset(self) -> Dataset:
        return load(self.options["dataset"])(self.options)

    def ranges(self, start: int, stop: int) -> list[Rows]:
        return [Rows(at, min(at + self.step, stop)) for at in range(start, stop, self.step)] or [Rows(start, start)]

    def read(self, part: Rows) -> Iterator:
        """A task that runs again reads the same rows."""
        yield from self.dataset().rows(part.start, part.stop) if part.stop > part.start else ()


class _Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[Rows]:
        return self.ranges(0, self.dataset().count())


class _Stream(_Reads, DataSourceStreamReader):
    """Offsets are numbers of rows, kept by Spark's checkpoint: each batch is the rows from one to the next."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": int(self.options.get("startrow", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"row": max(self.dataset().count(), self.initialOffset()["row"])}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return self.ranges(start["row"], end["row"])


class CustomDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _Reads(self.options).dataset().schema()

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


class ParquetRows:
    """The rows of a Parquet file or folder by number, in the order of its files; other row groups are not read.
    ``path`` may be of any store that Arrow reads; ``columns`` (with commas) picks some."""

    def __init__(self, options: dict[str, str]):
        import pyarrow.dataset as ds
        from pyarrow import fs

        path = options["path"]
        store, path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.data = ds.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=False)
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else self.data.schema.names

    def schema(self) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        found = from_arrow_schema(pa.schema([self.data.schema.field(c) for c in self.columns]))
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found)

    def count(self) -> int:
        return self.data.count_rows()

    def rows(self, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        at = 0
        for piece in sorted(self.data.get_fragments(), key=lambda f: f.path):
            if at >= stop:
                return
            for group in piece.split_by_row_group():
                n = group.row_groups[0].num_rows
                if at < stop and at + n > start:
                    inside = at
                    for batch in group.to_batches(columns=self.columns, batch_size=8192):
                        first, last = max(start - inside, 0), min(stop - inside, batch.num_rows)
                        if first < last:
                            yield batch.slice(first, last - first)
                        inside += batch.num_rows
                at += n


class JsonLines:
    """The complete lines of a file of JSON lines that others append to; ``schema`` names their fields. A last line
    without its end is not counted yet. Fields that a line lacks are null; a line that isn't JSON is a row of nulls."""

    def __init__(self, options: dict[str, str]):
        self.path, self.fields = options["path"].removeprefix("file://").removeprefix("file:"), options["schema"]
        self.names = [f.split()[0] for f in self.fields.split(",")]

    def schema(self) -> str:
        return self.fields

    def _lines(self) -> Iterator[bytes]:
        with open(self.path, "rb") as lines:
            for line in lines:
                if line.endswith(b"\n"):
                    yield line

    def count(self) -> int:
        return sum(1 for _ in self._lines())

    def rows(self, start: int, stop: int) -> Iterator[tuple]:
        for i, line in enumerate(self._lines()):
            if i >= stop:
                return
            if i >= start:
                try:
                    found = json.loads(line)
                except ValueError:
                    found = None
                yield tuple(found.get(n) if isinstance(found, dict) else None for n in self.names)


def _with_options(reader, dataset: str, options: dict):
    reader.option("dataset", dataset)
    for k, v in options.items():
        reader.option(k, v)
    return reader.load()


def read_dataset(spark: SparkSession, dataset: str, **options) -> DataFrame:
    """All rows of a custom dataset (``module:Class`` or ``/shared/file.py:Class``), a range of rows a task."""
    spark.dataSource.register(CustomDataset)
    return _with_options(spark.read.format(NAME), dataset, options)


def stream_dataset(spark: SparkSession, dataset: str, **options) -> DataFrame:
    """A custom dataset as a stream: what it has now, and its new rows as they come. With a checkpoint, a query that
    starts again goes on at the row after its last finished batch."""
    spark.dataSource.register(CustomDataset)
    return _with_options(spark.readStream.format(NAME), dataset, options)


def with_generated(df: DataFrame, generator: str, **options) -> DataFrame:
    """``df`` and the rows that a generator makes of it, a function (DataFrame, **options) -> DataFrame loaded by name.
    Columns are matched by name; one that the generator leaves out is null in its rows, one of its own is refused."""
    made = load(generator)(df, **options)
    extra = set(made.columns) - set(df.columns)
    if extra:
        raise ValueError(f"the generator has columns of its own: {', '.join(sorted(extra))}")
    return df.unionByName(made, allowMissingColumns=True).select(*df.columns)
