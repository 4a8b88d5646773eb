"""Folders of Arrow files as a Spark data source: ``spark.read.format("datamill_arrow")``.

Files in the random-access format are dealt out in ranges of record batches, those in the
streaming format as a whole. Tasks read the asked-for columns only and hand record batches on
as they are. Options: ``columns`` (names, comma-separated; without it all), ``batches`` (record
batches of a task). Writing makes a file of each task's batches, which gets its name when it is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from datamill.sources import stores
from datamill.tables import small_batches

FORMAT = "datamill_arrow"
SUFFIXES = (".arrow", ".feather")
BATCHES = 64
#: How a file in the random-access format begins.
MAGIC = b"ARROW1"


def arrow_files(folder: str) -> list[str]:
    return [path for path, _ in stores.listed(folder) if path.endswith(SUFFIXES)]


def has_footer(source) -> bool:
    begin = source.read(len(MAGIC))
    source.seek(0)
    return begin == MAGIC


def chosen(schema: pa.Schema, columns: list[str] | None) -> pa.ipc.IpcReadOptions:
    """Options that read the named columns' buffers only."""
    return pa.ipc.IpcReadOptions() if columns is None else pa.ipc.IpcReadOptions(included_fields=[schema.get_field_index(c) for c in columns])


def schema_of(source) -> pa.Schema:
    found = (pa.ipc.open_file if has_footer(source) else pa.ipc.open_stream)(source).schema
    source.seek(0)
    return found


class Batches(InputPartition):
    """Record batches first to last of a file; ``last`` is None in the streaming format."""

    def __init__(self, folder: str, path: str | None, first: int = 0, last: int | None = None):
        super().__init__(None)
        self.folder, self.path, self.first, self.last = folder, path, first, last


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.folder, self.names, self.batches = options["path"], names, int(options.get("batches", BATCHES))

    def partitions(self) -> list[Batches]:
        store, root = stores.opened(self.folder)
        out = []
        for path in arrow_files(self.folder):
            with store.open_input_file(f"{root}/{path}") as source:
                if not has_footer(source):
                    out.append(Batches(self.folder, path))
                    continue
                n = pa.ipc.open_file(source).num_record_batches
                out += [Batches(self.folder, path, i, min(i + self.batches, n)) for i in range(0, n, self.batches)]
        return out or [Batches(self.folder, None)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        store, root = stores.opened(partition.folder)
        with store.open_input_file(f"{root}/{partition.path}") as source:
            options = chosen(schema_of(source), self.names)
            if partition.last is None:
                found = iter(pa.ipc.open_stream(source, options=options))
            else:
                file = pa.ipc.open_file(source, options=options)
                found = (file.get_batch(i) for i in range(partition.first, partition.last))
            for batch in found:
                yield batch.select(self.names)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = stores.opened(self.folder)
        first = next(iterator, None)
        if first is None:
            return Written(None)
        path = f"{root}/part-{uuid.uuid4().hex}.arrow"

        def write(out) -> None:
            with pa.ipc.new_file(out, first.schema) as file:
                file.write_batch(first)
                for batch in iterator:
                    file.write_batch(batch)

        stores.put(store, path + ".unfinished", write)
        return Written(path)

    def commit(self, messages) -> None:
        store, root = stores.opened(self.folder)
        store.create_dir(root, recursive=True)
        for message in messages:
            if message and message.path:
                store.move(message.path + ".unfinished", message.path)

    def abort(self, messages) -> None:
        store, _ = stores.opened(self.folder)
        for message in messages:
            if message and message.path:
                store.delete_file(message.path + ".unfinished")


class ArrowFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        folder, columns = self.options["path"], self.options.get("columns")
        paths = arrow_files(folder)
        if not paths:
            raise ValueError(f"no Arrow files in {folder}; name a schema to read an empty folder")
        store, root = stores.opened(folder)
        with store.open_input_file(f"{root}/{paths[0]}") as source:
            found = schema_of(source)
        names = [c.strip() for c in columns.split(",")] if columns else found.names
        return from_arrow_schema(pa.schema([found.field(c) for c in names]))

    def reader(self, schema) -> DataSourceReader:
        return ArrowReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are added to a folder; it isn't overwritten")
        return ArrowWriter(dict(self.options))


def read_arrow(spark: SparkSession, folder: str, columns: list[str] | None = None, **options) -> DataFrame:
    spark.dataSource.register(ArrowFolder)
    rows = spark.read.format(FORMAT).options(**options)
    return (rows if columns is None else rows.option("columns", ",".join(columns))).load(folder)


def write_arrow(df: DataFrame, folder: str) -> None:
    small_batches(df.sparkSession)  # as written, so are they read
    df.sparkSession.dataSource.register(ArrowFolder)
    df.write.format(FORMAT).mode("append").save(folder)


def arrow_splits(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """The folders named as splits below ``folder``, with their ``split``; missing ones are skipped, none at all is an error."""
    store, root = stores.opened(folder)
    there = [s for s in splits if store.get_file_info(f"{root}/{s}").type == fs.FileType.Directory and arrow_files(f"{folder}/{s}")]
    if not there:
        raise ValueError(f"no Arrow files of {splits} in {folder}")
    rows = [read_arrow(spark, f"{folder}/{s}").withColumn("split", F.lit(s)) for s in there]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
