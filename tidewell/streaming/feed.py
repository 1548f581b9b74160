"""The change feed of a stored table as a stream: a Python data source over the commit log, whose offsets are versions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewell.session import ship
from tidewell.sources.bronze import filesystem, writable
from tidewell.sources.tables import Table

FORMAT = "tidewell_changes"


class Log:
    """A table's commits by Arrow's file systems, as workers have no JVM."""

    def __init__(self, path: str):
        self.fs, self.root = writable(path)

    def last(self) -> int:
        """The last version, -1 if there is none. The hint is read first, what was committed since is found one by one."""
        from pyarrow.fs import FileType

        there = lambda v: self.fs.get_file_info(self.name(v)).type == FileType.File
        try:
            with self.fs.open_input_stream(f"{self.root}/_log/_last") as stream:
                last = int(stream.read())
        except (OSError, ValueError):
            last = -1
        while there(last + 1):
            last += 1
        return last

    def name(self, version: int) -> str:
        return f"{self.root}/_log/{version:020d}.json"

    def commit(self, version: int) -> dict:
        with self.fs.open_input_stream(self.name(version)) as stream:
            return json.loads(stream.read())

    def files(self, version: int) -> list[str]:
        from pyarrow.fs import FileSelector

        found = self.fs.get_file_info(FileSelector(f"{self.root}/{self.commit(version)['feed']}"))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))


@dataclass
class Part(InputPartition):
    """One file of a version's feed."""

    version: int
    file: str


def rows(path: str, schema: T.StructType, part: Part) -> Iterator[pa.RecordBatch]:
    """Rows of a file, in the stream's columns; those it lacks are null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    log, want = Log(path), to_arrow_schema(schema)
    with log.fs.open_input_file(part.file) as stream:
        for batch in pq.ParquetFile(stream, coerce_int96_timestamp_unit="us").iter_batches(10_000):
            has = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"_commit_version": pa.array([part.version] * batch.num_rows, pa.int64())}
            columns = [has[f.name].cast(f.type) if f.name in has else pa.nulls(batch.num_rows, f.type) for f in want]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in want]))


class ChangeFeed(DataSource):
    """Options: ``path`` of the table, ``startingVersion`` (0 by default). Columns are those of the last version when the
    stream starts, with _change_type and _commit_version."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        log = Log(self.options["path"])
        last = log.last()
        if last < 0:
            raise ValueError(f"no table at {self.options['path']}")
        return T.StructType.fromJson(log.commit(last)["schema"]).add("_change_type", "string").add("_commit_version", "long")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Batch(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return Stream(self.options, schema)


class Batch(DataSourceReader):
    """All versions from the first to the last there is."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema, self.start = options["path"], schema, int(options.get("startingVersion", 0))

    def partitions(self) -> list[Part]:
        log = Log(self.path)
        return [Part(v, f) for v in range(self.start, log.last() + 1) for f in log.files(v)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return rows(self.path, self.schema, partition)


class Stream(DataSourceStreamReader):
    """Offsets are the versions that come next; a checkpoint goes on where it ended."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema, self.start = options["path"], schema, int(options.get("startingVersion", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(self.start, Log(self.path).last() + 1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        log = Log(self.path)
        return [Part(v, f) for v in range(start["version"], end["version"]) for f in log.files(v)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return rows(self.path, self.schema, partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go: the log stays."""


def place(table: Table) -> str:
    fs, path = filesystem(table.spark, table.path)
    return path(table.path).makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString()


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ChangeFeed)


def stream(table: Table, start: int = 0) -> DataFrame:
    """Changes of a table as they are committed, from a version on."""
    register(table.spark)
    return table.spark.readStream.format(FORMAT).option("path", place(table)).option("startingVersion", start).load()
