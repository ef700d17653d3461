"""A dictionary store with versions: words by range in Parquet files, deltas over them, and a manifest for each version.

folder/data/<name>/ holds the files of one write, folder/versions/<number>.json is a manifest: of each file its path, first and last word,
number of words and place in the order of writes. A version is there once its manifest is, which is moved into place whole; files are never
changed, so readers of a version see the same whatever is written later. Writers of one store take turns: one that finds a version newer
than that it began with fails and leaves no version.

Of a word's entries in one version the first written counts, but an upsert with winner "last" beats all before it. An entry that beats
another keeps the chunk of the one that it beats, so additions never move a word between chunks; a new word is in the chunk that it
comes with. `compact` writes a version without deltas, `vacuum` drops versions and the files that no kept one has.

A reader that asks for a prefix opens only the files whose range of words can have it. Words go by the order of their UTF-8 bytes.
A store without a version is an error; one without words has no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_source import file_system

SCHEMA = "word string, rank long, score long, chunk_id long"
_COLUMNS = ["word", "rank", "score", "chunk_id"]


def versions(folder: str) -> list[int]:
    """Numbers of the versions, in order."""
    from pyarrow import fs

    files, top = file_system(folder)
    found = files.get_file_info(fs.FileSelector(f"{top}/versions", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name[:-5].isdigit() and f.base_name.endswith(".json"))


def manifest(folder: str, version: int | None = None) -> tuple[int, list[dict]]:
    """The number and the files of a version, the newest if none is named."""
    have = versions(folder)
    if not have or (version is not None and version not in have):
        raise ValueError(f"{folder} has no version" + ("" if version is None else f" {version}"))
    version = have[-1] if version is None else version
    files, top = file_system(folder)
    with files.open_input_stream(f"{top}/versions/{version:08d}.json") as f:
        return version, json.loads(f.read())


def _publish(folder: str, entries: list[dict], before: int) -> int:
    """Moves the manifest of the version after `before` into place."""
    files, top = file_system(folder)
    if (versions(folder) or [0])[-1] != before:
        raise RuntimeError(f"another writer made a version after {before}")
    files.create_dir(f"{top}/versions", recursive=True)
    with files.open_output_stream(path := f"{top}/versions/_{uuid.uuid4().hex}") as f:
        f.write(json.dumps(entries).encode())
    files.move(path, f"{top}/versions/{before + 1:08d}.json")
    return before + 1


def _write(words: DataFrame, folder: str, priority: int, parts: int | None) -> list[dict]:
    """Writes words by range; returns their entries of a manifest, one a file."""
    spark, path = words.sparkSession, f"{folder.rstrip('/')}/data/{uuid.uuid4().hex}"
    words = words.select("word", *[F.col(c).cast("long").alias(c) for c in _COLUMNS[1:]])
    ranges = words.repartitionByRange(*([parts] if parts else []), "word").sortWithinPartitions("word")
    ranges.write.parquet(path)
    name = F.regexp_extract("_metadata.file_path", r"[^/]+$", 0)
    found = spark.read.schema(SCHEMA).parquet(path).groupBy(name.alias("file")).agg(F.min("word").alias("first"), F.max("word").alias("last"), F.count("*").alias("words"))
    return [{"path": f"{path[len(folder.rstrip('/')) + 1 :]}/{r['file']}", "first": r["first"], "last": r["last"], "words": r["words"], "priority": priority} for r in found.collect()]


def create(dictionary: DataFrame, folder: str, parts: int | None = None) -> int:
    """A version of these words alone; returns its number. parts: ranges of words, by default Spark's own number."""
    before = (versions(folder) or [0])[-1]
    return _publish(folder, _write(dictionary, folder, 0, parts), before)


def upsert(words: DataFrame, folder: str, winner: str = "first", parts: int | None = None) -> int:
    """A version with these words (one row each) over the newest one's; winner: which entry counts where a word has several."""
    if winner not in ("first", "last"):
        raise ValueError("winner is first or last")
    before, entries = manifest(folder)
    turn = max((abs(e["priority"]) for e in entries), default=0) + 1
    return _publish(folder, entries + _write(words, folder, turn if winner == "first" else -turn, parts), before)


def files_of(folder: str, prefix: str = "", version: int | None = None) -> list[dict]:
    """A version's files that can have words with the prefix."""
    key = prefix.encode()
    return [e for e in manifest(folder, version)[1] if e["last"] is not None and e["last"].encode() >= key and (e["first"].encode() <= key or e["first"].startswith(prefix))]


def read(spark: SparkSession, folder: str, prefix: str = "", version: int | None = None) -> DataFrame:
    """word, rank, score, chunk_id: the words of a version that start with the prefix."""
    own, whole = files_of(folder, prefix, version), None
    for priority in sorted({e["priority"] for e in own}):
        paths = [f"{folder.rstrip('/')}/{e['path']}" for e in own if e["priority"] == priority]
        rows = spark.read.schema(SCHEMA).parquet(*paths).withColumn("p", F.lit(priority))
        whole = rows if whole is None else whole.unionByName(rows)
    if whole is None:
        return spark.createDataFrame([], SCHEMA)
    whole = whole.filter(F.col("word").startswith(prefix)) if prefix else whole
    if len({e["priority"] for e in own}) == 1:
        return whole.select(*_COLUMNS)
    # What counts is the entry of the least priority; the chunk is that of the entry written first.
    best = F.min_by(F.struct("rank", "score"), "p")
    return whole.groupBy("word").agg(best.alias("e"), F.min_by("chunk_id", F.abs("p")).alias("chunk_id")).select("word", "e.rank", "e.score", "chunk_id")


def compact(spark: SparkSession, folder: str, parts: int | None = None) -> int:
    """A version of the newest one's words without deltas."""
    before, _ = manifest(folder)
    return _publish(folder, _write(read(spark, folder, version=before), folder, 0, parts), before)


def vacuum(folder: str, keep: int = 1) -> int:
    """Drops all but the newest `keep` versions and the data that none of these has; returns how many versions went. No writer may be at work."""
    from pyarrow import fs

    if keep < 1:
        raise ValueError("the newest version stays")
    files, top = file_system(folder)
    old, kept = versions(folder)[:-keep], versions(folder)[-keep:]
    used = {e["path"].split("/")[1] for v in kept for e in manifest(folder, v)[1]}
    for v in old:
        files.delete_file(f"{top}/versions/{v:08d}.json")
    for d in files.get_file_info(fs.FileSelector(f"{top}/data", allow_not_found=True)):
        if d.base_name not in used:
            files.delete_dir(d.path)
    return len(old)
