"""The compact binary chunk format: little-endian int32 count, then for each word uint16 length, UTF-8 bytes, uint16 rank."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import chunk_id_of, score_of_rank

MAX_COUNT = 1_000_000


def encode(entries: list[tuple[str, int]]) -> bytes:
    """Entries in byte order of their words, ranks narrowed to 16 bits."""
    rows = sorted((w.encode(), r % 65_536) for w, r in entries)
    return struct.pack("<i", len(rows)) + b"".join(struct.pack("<H", len(w)) + w + struct.pack("<H", r) for w, r in rows)


def decode(data: bytes, mode: str = "PERMISSIVE") -> Iterator[tuple[str, int]]:
    """Words and ranks. An end between records ends the chunk; one inside a record raises (FAILFAST) or ends it too."""
    if len(data) < 4:
        if mode == "FAILFAST":
            raise ValueError("chunk too short")
        return
    (n,), at = struct.unpack_from("<i", data), 4
    for _ in range(n):
        if at == len(data) and mode != "FAILFAST":
            return
        end = at + 2 + (struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else 0)
        if at + 2 > len(data) or end + 2 > len(data):
            if mode == "FAILFAST":
                raise ValueError(f"chunk ends inside a record at byte {at}")
            return
        yield data[at + 2 : end].decode("utf-8", "replace"), struct.unpack_from("<H", data, end)[0]
        at = end + 2


def files(spark: SparkSession, folder: str) -> DataFrame:
    """id, filename, word_count from the headers of dict_*.bin; names without a number are left out, an unreadable header counts 0."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "dict_*.bin").load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    head = F.hex(F.substring("content", 1, 4))
    count = F.conv(F.concat(*[F.substring(head, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    return raw.select(chunk_id_of(name).alias("id"), name.alias("filename"), F.when(F.length("content") >= 4, count).otherwise(0).alias("word_count")).filter("id is not null")


def read(spark: SparkSession, folder: str, mode: str = "PERMISSIVE") -> DataFrame:
    """word, rank, score, chunk_id of all chunks of a folder; a task decodes one file at a time."""

    def run(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                found = list(decode(data, mode))
                if found:
                    yield pd.DataFrame({"path": [name] * len(found), "word": [w for w, _ in found], "rank": [r for _, r in found]})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "dict_*.bin").load(folder).select("path", "content")
    rows = raw.mapInPandas(run, "path string, word string, rank long")
    return rows.select("word", "rank", score_of_rank(F.col("rank")).alias("score"), chunk_id_of(F.regexp_extract("path", r"[^/]+$", 0)).cast("long").alias("chunk_id"))


def contents(dictionary: DataFrame) -> DataFrame:
    """filename, content: each chunk as a file's bytes. A chunk has at most its chunk size of words, so a group is bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"filename": [f"dict_{int(pdf['chunk_id'].iloc[0]):04d}.bin"], "content": [encode(list(zip(pdf["word"], pdf["rank"], strict=True)))]})

    return dictionary.select("chunk_id", "word", "rank").groupBy("chunk_id").applyInPandas(run, "filename string, content binary")


def write(dictionary: DataFrame, folder: str) -> None:
    """Writes the chunk files, through a file system that pyarrow knows."""

    def run(batches):
        from pyarrow import fs

        files_, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files_.create_dir(top, recursive=True)
        for b in batches:
            for name, data in zip(b["filename"], b["content"], strict=True):
                with files_.open_output_stream(f"{top}/{name}") as out:
                    out.write(data)
                yield pd.DataFrame({"filename": [name]})

    contents(dictionary).mapInPandas(run, "filename string").count()


def validated(spark: SparkSession, folder: str) -> DataFrame:
    """filename, format, valid, reason (where not) of a folder's files: size, extension, and a count from 0 to 1,000,000 in a binary header.

    Files without a byte have no row: Spark's reader leaves them out.
    """
    raw = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    ext = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    head = F.hex(F.substring("content", 1, 4))
    count = F.conv(F.concat(*[F.substring(head, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    kind = F.when(ext == ".bin", "binary").when(ext == ".txt", "text").otherwise("unknown")
    least = F.when(kind == "binary", 4).otherwise(1)
    reason = (
        F.when(kind == "unknown", "unknown format").when(F.col("length") < least, "file too small")
        .when((kind == "binary") & (count >= 2**31), "negative word count").when((kind == "binary") & (count > MAX_COUNT), "word count too large")
    )
    return raw.select(name.alias("filename"), kind.alias("format"), reason.isNull().alias("valid"), reason.alias("reason"))


def bulk(files_: DataFrame) -> DataFrame:
    """chunk_id, word, rank of chunks that come as bytes (filename, content), in the order of their numbers, all or nothing for each.

    Empty content is left out; the first chunk that is broken ends the load, those before it stay. Of a word's repeats in a chunk the
    last counts.
    """

    def run(batches):
        for b in batches:
            for name, data in zip(b["filename"], b["content"], strict=True):
                try:
                    found = dict(decode(data, "FAILFAST"))
                except ValueError:
                    yield pd.DataFrame({"filename": [name], "word": [None], "rank": [None]})
                else:
                    yield pd.DataFrame({"filename": [name] * len(found), "word": list(found), "rank": list(found.values())})

    given = files_.filter("content is not null and length(content) > 0").select("filename", "content")
    rows = given.mapInPandas(run, "filename string, word string, rank long").withColumn("chunk_id", chunk_id_of(F.col("filename")).cast("long"))
    broken = rows.filter("word is null").agg(F.min("chunk_id").alias("broken"))
    rows = rows.filter("word is not null").crossJoin(F.broadcast(broken))  # one row
    return rows.filter("broken is null or chunk_id < broken").select("chunk_id", "word", "rank")


def formats(spark: SparkSession) -> DataFrame:
    """The known formats."""
    rows = [("binary", "Binary Dictionary", [".bin"], 4), ("text", "Plain Text Dictionary", [".txt"], 1)]
    return spark.createDataFrame(rows, "format string, description string, extensions array<string>, min_size long")


def store(dictionary: DataFrame, path: str) -> None:
    """The canonical store: Parquet by chunk, words in order, so that prefixes and chunks prune what is read."""
    dictionary.repartition("chunk_id").sortWithinPartitions("chunk_id", "word").write.mode("overwrite").partitionBy("chunk_id").parquet(path)
