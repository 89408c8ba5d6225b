"""The benchmark log as a data source: ``spark.read.format("benchlog").load(path)``.

A partition for each CSV file, with ``hostname``, ``jobid`` and ``file`` from its
name; with the option ``hostname`` other hosts' files are never opened.  Writing gives one file a task.  Files are written under a name that no
reader takes and get their own when all tasks have ended; an aborted task or job
leaves nothing.

Paths are those that :mod:`pyarrow.fs` opens from executors and driver alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestar.model import BENCH
from lodestar.shipping import ship

NAMED = [StructField("hostname", StringType()), StructField("jobid", LongType()), StructField("file", StringType())]
SCHEMA = StructType([*BENCH.fields, *NAMED])
#: Fixed value: host and job in the name of a file or of the folder that it is in.
NAME = re.compile(r"-([A-Za-z0-9]+)-(\d+)\.csv(?:/[^/]*)?$")
_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
COLUMNS = {f.name: _KINDS[f.dataType.simpleString()] for f in BENCH}


def opened(path: str) -> tuple[files.FileSystem, str]:
    if "://" in path:
        return files.FileSystem.from_uri(path)
    return files.LocalFileSystem(), re.sub(r"^file:", "", path)


def hidden(path: str) -> bool:
    """Names that readers pass over, as Spark's do."""
    return path.rsplit("/", 1)[-1].startswith(("_", "."))


def named(path: str) -> tuple[str | None, int | None]:
    found = NAME.search(path)
    return (found[1], int(found[2])) if found else (None, None)


@dataclass
class LogFile(InputPartition):
    path: str


class LogReader(DataSourceReader):
    def __init__(self, path: str, host: str | None = None):
        self.path, self.host = path, host

    def partitions(self) -> list[LogFile]:
        system, top = opened(self.path)
        about = system.get_file_info(top)
        inside = system.get_file_info(files.FileSelector(top, recursive=True)) if about.type == files.FileType.Directory else [about]
        found = sorted(x.path for x in inside if x.type == files.FileType.File and x.path.endswith(".csv") and x.size and not hidden(x.path))
        if about.type == files.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return [LogFile(p) for p in found if self.host is None or named(p)[0] == self.host]

    def read(self, partition: LogFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        system, _ = opened(self.path)
        host, job = named(partition.path)
        convert = csv.ConvertOptions(column_types=COLUMNS, include_columns=list(COLUMNS), include_missing_columns=True, null_values=[""], strings_can_be_null=True)
        with system.open_input_stream(partition.path) as stream:
            for batch in csv.open_csv(stream, convert_options=convert):
                more = [pa.array([x] * batch.num_rows, k) for x, k in ((host, pa.string()), (job, pa.int64()), (partition.path, pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], SCHEMA.names)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class LogWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        missing = set(COLUMNS) - set(names)
        if missing:
            raise ValueError(f"a log needs {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, top = opened(self.path)
        path, rows, writer = f"{top}/_{self.job}-{uuid.uuid4().hex}.csv", [], None
        schema = pa.schema(list(COLUMNS.items()))
        try:
            for row in iterator:
                if writer is None:
                    system.create_dir(top, recursive=True)
                    writer = csv.CSVWriter(system.open_output_stream(path), schema)
                rows.append({c: row[c] for c in COLUMNS})
                if len(rows) == 10_000:
                    writer.write_batch(pa.RecordBatch.from_pylist(rows, schema))
                    rows = []
            if writer is None:
                return Written(None)
            if rows:
                writer.write_batch(pa.RecordBatch.from_pylist(rows, schema))
            writer.close()
        except BaseException:
            if writer is not None:
                writer.close()
                system.delete_file(path)
            raise
        return Written(path)

    def _left(self, keep: set[str]) -> None:
        """What attempts of this job have written that does not count goes."""
        system, top = opened(self.path)
        if system.get_file_info(top).type == files.FileType.Directory:
            for x in system.get_file_info(files.FileSelector(top)):
                if x.path.rsplit("/", 1)[-1].startswith(f"_{self.job}-") and x.path not in keep:
                    system.delete_file(x.path)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = opened(self.path)
        system.create_dir(top, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(files.FileSelector(top)):
                if x.path.endswith(".csv") and not hidden(x.path):
                    system.delete_file(x.path)
        for i, m in enumerate(sorted(m.path for m in messages if m is not None and m.path)):
            system.move(m, f"{top}/part-{i:05}-{self.job}.csv")
        self._left(set())

    def abort(self, messages: list[Written | None]) -> None:
        self._left(set())


class BenchLog(DataSource):
    """Options ``path``: a CSV file, or a folder of them at any depth; ``hostname``: read this host's files alone."""

    @classmethod
    def name(cls) -> str:
        return "benchlog"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], self.options.get("hostname"))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(BenchLog)
