"""Corpus files in chunks, and one text file per row, as Python data sources.

``corpus_chunks`` reads text files of any size: its partitions are byte ranges that
begin and end at character bounds, so no row holds more than ``chunk_bytes`` (plus
one character) and a file is read by many tasks.  ``text_files`` writes each row's
``content`` to a file of its ``file_name``.  A task writes into a folder of its own
attempt; the commit renames the folders of the attempts that count, so a task that
is run again leaves no second file.  Both work on paths that every node mounts; in
other stores use ``readers.read_corpus_lines`` and a Parquet table.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK_BYTES = 8 << 20


def mounted_path(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a mounted path: {path}")
    return parts.path if parts.scheme else path


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def read_range(path: str, start: int, end: int) -> str:
    """Characters of a UTF-8 file whose first byte lies in [start, end)."""
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read(end - start)
        rest = f.read(3)
    inner = lambda b: b & 0xC0 == 0x80
    lo = 0
    while lo < len(data) and inner(data[lo]):  # the character began in the range before
        lo += 1
    hi = 0
    while data[lo:] and hi < len(rest) and inner(rest[hi]):
        hi += 1
    return (data[lo:] + rest[:hi]).decode("utf-8")


class CorpusReader(DataSourceReader):
    def __init__(self, path: str, extension: str, chunk_bytes: int):
        self.path, self.extension, self.chunk_bytes = mounted_path(path), extension, chunk_bytes

    def partitions(self) -> list[ByteRange]:
        found = []
        for entry in sorted(os.scandir(self.path), key=lambda e: e.name):
            if entry.is_file() and entry.name.endswith(f".{self.extension}") and not entry.name.startswith((".", "_")):
                size = entry.stat().st_size
                found += [ByteRange(entry.path, at, min(size, at + self.chunk_bytes)) for at in range(0, max(1, size), self.chunk_bytes)]
        return found

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        yield os.path.basename(partition.path), partition.start, read_range(partition.path, partition.start, partition.end)


class CorpusChunks(DataSource):
    """``file_name, start, content``: options ``path``, ``extension`` (txt), ``chunk_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_chunks"

    def schema(self) -> str:
        return "file_name string, start bigint, content string"

    def reader(self, schema: StructType) -> CorpusReader:
        o = self.options
        return CorpusReader(o["path"], o.get("extension", "txt"), int(o.get("chunk_bytes", CHUNK_BYTES)))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class TextFileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = mounted_path(path)
        self.pending = os.path.join(self.path, "_pending")

    def write(self, iterator: Iterator) -> Written:
        folder, files = uuid.uuid4().hex, 0
        for row in iterator:
            if not files:
                os.makedirs(os.path.join(self.pending, folder))
            with open(os.path.join(self.pending, folder, row["file_name"]), "w", encoding="utf-8", newline="") as f:
                f.write(row["content"] or "")
            files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.files:
                os.rename(os.path.join(self.pending, m.folder), os.path.join(self.path, f"part-{m.folder}"))
        shutil.rmtree(self.pending, ignore_errors=True)  # attempts that do not count

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class TextFiles(DataSource):
    """Sink of (file_name, content); option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "file_name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> TextFileWriter:
        return TextFileWriter(self.options["path"])


def read_corpus_chunks(spark: SparkSession, path: str, extension: str = "txt", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(file_name, start, content)``; the contents of a file in the order of ``start`` are the file."""
    spark.dataSource.register(CorpusChunks)
    return (spark.read.format("corpus_chunks").option("path", path).option("extension", extension)
                 .option("chunk_bytes", chunk_bytes).load())


def write_text_files(df: DataFrame, path: str) -> None:
    """One file per row of ``df`` (file_name, content), in folders ``part-*`` of ``path``."""
    df.sparkSession.dataSource.register(TextFiles)
    df.select("file_name", "content").write.format("text_files").option("path", path).mode("append").save()
