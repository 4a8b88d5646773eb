"""Folders of documents as a Spark data source: ``spark.read.format("datamill")``.

The driver lists the folder and deals its files out in blocks; a task reads a block, a file
at a time. A file goes to the first parser that can take it. Files that no parser takes have
their text in ``value``, for parsers that are made of columns (``files.parsed``). What can't be
read is a row with ``_error``: a file that is gone, bytes that are no UTF-8, a parser that fails.

Options: ``block_files`` and ``block_bytes`` bound a block. Writing takes ``source_path`` (below
the folder) and ``value`` (binary) and makes a file of each row; each appears whole or not at
all, so tasks may be run again.
"""

from __future__ import annotations

import posixpath
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from datamill.sources import files, stores

FORMAT = "datamill"
SCHEMA = "source_path string, size long, parser string, title string, content string, code_blocks array<string>, metadata map<string,string>, value string, _error string"
BLOCK_FILES, BLOCK_BYTES = 1000, 64 << 20


@dataclass
class Document:
    """What a parser makes of a file."""

    content: str
    title: str = ""
    code_blocks: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)


class DocumentParser(ABC):
    """Reads one kind of file. Subclass it, and register it with ``use_parsers``."""

    name: str = ""
    suffixes: tuple[str, ...] = ()

    def can_parse(self, path: str) -> bool:
        return path.lower().endswith(self.suffixes)

    @abstractmethod
    def parse(self, path: str, text: str) -> Document:
        """The document in a file; what it raises becomes the row's error."""


class Block(InputPartition):
    """Some files of a folder."""

    def __init__(self, folder: str, paths: list[str]):
        super().__init__(None)
        self.folder, self.paths = folder, paths


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict, parsers: list[DocumentParser]):
        self.folder, self.parsers = options["path"], parsers
        self.most_files, self.most_bytes = int(options.get("block_files", BLOCK_FILES)), int(options.get("block_bytes", BLOCK_BYTES))

    def partitions(self) -> list[Block]:
        return [Block(self.folder, paths) for paths in stores.blocks(stores.listed(self.folder), self.most_files, self.most_bytes)] or [Block(self.folder, [])]

    def read(self, partition: Block) -> Iterator[tuple]:
        store, root = stores.opened(partition.folder)
        for path in partition.paths:
            yield self.row(store, root, path)

    def row(self, store, root: str, path: str) -> tuple:
        size = name = None
        try:
            with store.open_input_stream(f"{root}/{path}") as f:
                data = f.read()
            size, text = len(data), data.decode()
            for parser in self.parsers:
                if parser.can_parse(path):
                    name = parser.name
                    d = parser.parse(path, text)
                    return path, size, name, d.title, d.content, d.code_blocks, d.metadata, None, None
            return path, size, None, None, None, None, None, text, None
        except FileNotFoundError:
            error = "the file is gone"
        except UnicodeDecodeError:
            error = "not UTF-8"
        except Exception as e:  # noqa: BLE001  a parser's failure is the row's
            error = f"{type(e).__name__}: {e}"
        return path, size, name, None, None, None, None, None, error


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator) -> Written:
        store, root = stores.opened(self.folder)
        paths = []
        for row in iterator:
            path = posixpath.normpath(row["source_path"])
            if path.startswith(("/", "..")):
                raise ValueError(f"{path} isn't below the folder")
            stores.put(store, f"{root}/{path}", lambda out, data=row["value"]: out.write(bytes(data or b"")))
            paths.append(path)
        return Written(paths)

    def abort(self, messages) -> None:
        store, root = stores.opened(self.folder)
        for message in filter(None, messages):
            for path in message.paths:
                store.delete_file(f"{root}/{path}")


def source_with(parsers: list[DocumentParser], name: str = FORMAT) -> type[DataSource]:
    """A data source whose tasks use ``parsers``."""

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return DocumentReader(dict(self.options), parsers)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if overwrite:
                raise ValueError("files are added to a folder; it isn't overwritten")
            return DocumentWriter(dict(self.options))

    return Documents


def use_parsers(spark: SparkSession, *parsers: DocumentParser) -> None:
    """Register the data source with these parsers, the first that can take a file first."""
    spark.dataSource.register(source_with(list(parsers)))


def read_documents(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All documents of a folder (source_path, parser, title, content, code_blocks, _error): by registered parsers, else by those made of columns."""
    raw = spark.read.format(FORMAT).options(**options).load(folder)
    columns = ["source_path", "parser", "title", "content", "code_blocks", "_error"]
    done = F.col("value").isNull()
    return raw.where(done).select(*columns).unionByName(files.parsed(raw.where(~done).select("source_path", "value")).select(*columns))
