"""A sink with a commit protocol, as a Python data source: ``rows.write.format("committed")`` and ``writeStream.format("committed")``.

Every task writes its rows to a file of its own name and tells the driver; when all tasks have ended the driver commits once, by putting a small file into place that names
the files of the batch. Readers (``read_committed``) read what commits name and nothing else, so the file of a task that was killed, or ran twice,
is never read, and a batch that is run again after its commit changes nothing: commits are named by the batch id. A write that fails removes its files.

The folder is one that all executors reach by a path that pyarrow knows (a shared file system, HDFS or an object store).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass
class Written(WriterCommitMessage):
    """A task's file, if it had rows."""

    name: str | None
    rows: int


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _commit(path: str, batch: str, messages: list) -> bool:
    """Name the batch's files, unless it was committed before; True if this commit holds."""
    files, folder = _open(path)
    files.create_dir(f"{folder}/commits", recursive=True)
    if batch in _commits(path):
        return False
    named = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
    temporary = f"{folder}/commits/.{batch}-{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(json.dumps(named).encode())
    files.move(temporary, f"{folder}/commits/{batch}.json")
    return True


def _remove(path: str, messages: list) -> None:
    files, folder = _open(path)
    for m in messages:
        if m is not None and m.name:
            files.delete_file(f"{folder}/data/{m.name}")


def _commits(path: str) -> dict[str, list[dict]]:
    from pyarrow import fs

    files, folder = _open(path)
    found = {}
    for info in files.get_file_info(fs.FileSelector(f"{folder}/commits", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as source:
                found[info.base_name.removesuffix(".json")] = json.loads(source.read())
    return found


class _Stage:
    """What tasks do: write their rows to a file that nobody reads yet."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, folder = _open(self.path)
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch]).cast(to_arrow_schema(self.schema))
                if writer is None:
                    files.create_dir(f"{folder}/data", recursive=True)
                    writer = pq.ParquetWriter(f"{folder}/data/{name}", table.schema, filesystem=files)
                writer.write_table(table)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else None, rows)


class _BatchWriter(_Stage, DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, batch: str, overwrite: bool):
        super().__init__(path, schema)
        self.batch, self.overwrite = batch, overwrite

    def commit(self, messages: list) -> None:
        if self.overwrite:
            files, folder = _open(self.path)
            for name in _commits(self.path):
                files.delete_file(f"{folder}/commits/{name}.json")
        if not _commit(self.path, self.batch, messages):
            _remove(self.path, messages)

    def abort(self, messages: list) -> None:
        _remove(self.path, messages)


class _StreamWriter(_Stage, DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: T.StructType, query: str):
        super().__init__(path, schema)
        self.query = query

    def commit(self, messages: list, batchId: int) -> None:
        if not _commit(self.path, f"{self.query}-{batchId}", messages):
            _remove(self.path, messages)

    def abort(self, messages: list, batchId: int) -> None:
        _remove(self.path, messages)


class Committed(DataSource):
    """Options: path; batch, the name of a batch write (a write with a name that was committed changes nothing); query, the name under which a stream commits."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self.options["path"], schema, self.options.get("batch", uuid.uuid4().hex), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], schema, self.options.get("query", "stream"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Committed)


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all commits at a path."""
    names = sorted(f["name"] for named in _commits(path).values() for f in named)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{n}" for n in names))
