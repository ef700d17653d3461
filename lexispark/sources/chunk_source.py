"""Chunk files as a Spark data source: `spark.read.format("chunks").load(folder)` and `df.write.format("chunks").save(folder)`.

Reading gives word, rank, chunk_id, one partition a file. With option headers=true it gives id, filename, word_count and bytes_read
instead: of each file only the four bytes of its header are read. Conditions on the chunk's number are pushed to the listing of files, so that other
files are not opened; Spark asks for them where spark.sql.python.filterPushdown.enabled is set. mode: PERMISSIVE (a file that ends inside a
record ends there) or FAILFAST.

Writing takes word, rank, chunk_id. Each task writes whole chunks to files of its own in a staging folder and names them in its commit
message; the driver moves the named files into place once all tasks have committed, and removes the staging folder whether the write
succeeds or not. So what failed or repeated tasks wrote is never seen. An overwriting write removes the chunks that it did not write after
its own are in place; an appending one fails where a chunk is there already. A chunk must lie in one partition, in a run: `write` sees to
it. The file systems are those that pyarrow knows, by URI or local path.

An empty folder or table gives no rows, and no file. A null word or rank fails the write.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .binary_chunks import decode, encode

ROWS, HEADERS = "word string, rank int, chunk_id int", "id int, filename string, word_count long, bytes_read long"
_NAME = re.compile(r"dict_([+-]?[0-9]+)\.bin$")


def file_system(folder: str):
    """The file system of a folder, and its path there."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def listed(folder: str) -> list[tuple[int, str]]:
    """Number and path of each chunk file, in the order of the numbers; names without a number are left out."""
    from pyarrow import fs

    files, top = file_system(folder)
    found = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return sorted((int(m[1]), f.path) for f in found if f.is_file and (m := _NAME.search(f.base_name)))


@dataclass
class File(InputPartition):
    chunk_id: int
    path: str

    def __post_init__(self):
        super().__init__(self.path)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return HEADERS if self._headers() else ROWS

    def _headers(self) -> bool:
        return self.options.get("headers", "false").lower() == "true"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options["path"], self._headers(), self.options.get("mode", "PERMISSIVE"))

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        if schema.names != ["word", "rank", "chunk_id"]:
            raise ValueError("a chunk has word, rank, chunk_id")
        return ChunkWriter(self.options["path"], overwrite)


class ChunkReader(DataSourceReader):
    def __init__(self, folder: str, headers: bool, mode: str):
        self.folder, self.headers, self.mode, self.kept = folder, headers, mode, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on the chunk's number; the others stay with Spark."""
        column = "id" if self.headers else "chunk_id"
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (column,):
                self.kept.append(f)
            else:
                yield f

    def _asked(self, number: int) -> bool:
        for f in self.kept:
            match f:
                case EqualTo(_, v):
                    ok = number == v
                case In(_, v):
                    ok = number in v
                case GreaterThan(_, v):
                    ok = number > v
                case GreaterThanOrEqual(_, v):
                    ok = number >= v
                case LessThan(_, v):
                    ok = number < v
                case LessThanOrEqual(_, v):
                    ok = number <= v
            if not ok:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [File(n, path) for n, path in listed(self.folder) if self._asked(n)]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file
            return
        files, _ = file_system(self.folder)
        with files.open_input_file(partition.path) as f:
            if self.headers:
                head = f.read_at(min(4, f.size()), 0)
                yield partition.chunk_id, posixpath.basename(partition.path), struct.unpack("<i", head)[0] if len(head) == 4 else 0, len(head)
            else:
                for word, rank in decode(f.read(), self.mode):
                    yield word, rank, partition.chunk_id


@dataclass
class Staged(WriterCommitMessage):
    """Chunk number and staged path of each file of a task."""

    files: list[tuple[int, str]]


class ChunkWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.staging = folder, overwrite, f"_staging-{uuid.uuid4().hex}"

    def _stage(self) -> str:
        return f"{file_system(self.folder)[1]}/{self.staging}"

    def write(self, iterator) -> Staged:
        files, _ = file_system(self.folder)
        folder, out, number, entries = f"{self._stage()}/{uuid.uuid4().hex}", [], None, []

        def close():
            if any(n == number for n, _ in out):
                raise ValueError(f"the rows of chunk {number} do not stand together")
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(path := f"{folder}/dict_{number:04d}.bin") as f:
                f.write(encode(entries))
            out.append((number, path))

        for row in iterator:
            if row.word is None or row.rank is None or row.chunk_id is None:
                raise ValueError("a chunk has no null words, ranks or numbers")
            if entries and row.chunk_id != number:
                close()
                entries = []
            number = row.chunk_id
            entries.append((row.word, row.rank))
        if entries:
            close()
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        files, top = file_system(self.folder)
        staged = [f for m in messages if m for f in m.files]
        numbers = [n for n, _ in staged]
        before = dict(listed(self.folder))
        try:
            if len(set(numbers)) < len(numbers):
                raise ValueError(f"chunk {min(n for n in numbers if numbers.count(n) > 1)} lies in several partitions")
            if not self.overwrite and (there := sorted(before.keys() & set(numbers))):
                raise ValueError(f"chunk {there[0]} is there already")
            files.create_dir(top, recursive=True)
            for n, path in sorted(staged):
                files.move(path, f"{top}/dict_{n:04d}.bin")
            if self.overwrite:
                for n, path in before.items():
                    if n not in numbers:
                        files.delete_file(path)
        finally:
            self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, _ = file_system(self.folder)
        files.delete_dir_contents(self._stage(), missing_dir_ok=True)
        if files.get_file_info(self._stage()).type.name != "NotFound":
            files.delete_dir(self._stage())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets conditions on the chunk's number reach it."""
    spark.dataSource.register(ChunkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, folder: str, mode: str = "PERMISSIVE") -> DataFrame:
    """word, rank, chunk_id of a folder's chunks."""
    register(spark)
    return spark.read.format("chunks").option("mode", mode).load(folder)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """id, filename, word_count, bytes_read of a folder's chunks, from their headers alone."""
    register(spark)
    return spark.read.format("chunks").option("headers", "true").load(folder)


def write(dictionary: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Writes the chunks of a dictionary (word, rank, chunk_id)."""
    register(dictionary.sparkSession)
    rows = dictionary.selectExpr("word", "cast(rank as int) as rank", "cast(chunk_id as int) as chunk_id")
    rows.repartition("chunk_id").sortWithinPartitions("chunk_id").write.format("chunks").mode(mode).save(folder)
