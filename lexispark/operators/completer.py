"""The exchangeable completer: what the server, the command line and the browser entry need of one, and the one over a table."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import chunk_source
from ..sources.shared import cut
from ..functions.exprs import score_of_rank
from . import complete as c
from . import dictionary as d

#: Added words that are held as rows of their own before they go into the table.
HELD = 10_000


class Completer(Protocol):
    def complete(self, prefix: str, limit: int) -> DataFrame: ...
    def add_word(self, word: str, score: int) -> None: ...
    def initialize(self) -> None: ...
    def stats(self) -> DataFrame: ...
    def load_chunk(self, path: str) -> None: ...
    def load_all(self, folder: str) -> None: ...


class TableCompleter:
    """A completer over a dictionary table (word, score, chunk_id).

    Added words are gathered in one table beside it: they have no chunk (null), and a word that a loaded chunk has keeps its score and chunk.
    Of a word in several chunks the entry of the lowest chunk counts. available: ids of all chunks there are, else those that are loaded.
    """

    def __init__(self, spark: SparkSession, words: DataFrame | None = None, available: DataFrame | None = None):
        self.spark, self.available, self._added = spark, available, {}
        self._loaded = spark.createDataFrame([], "word string, score long, chunk_id long") if words is None else words

    @property
    def words(self) -> DataFrame:
        """word, score, chunk_id of all words, each once."""
        if not self._added:
            return self._loaded
        more = self.spark.createDataFrame([(w, s, None) for w, s in self._added.items()], "word string, score long, chunk_id long")
        return self._merged(self._loaded.select("word", "score", "chunk_id").unionByName(more))

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        order = F.struct(F.col("chunk_id").isNull().alias("added"), "chunk_id")
        return rows.groupBy("word").agg(F.min_by("score", order).alias("score"), F.min("chunk_id").alias("chunk_id"))

    def initialize(self) -> None:
        """Reads the table into memory once."""
        self._loaded = self._loaded.cache()

    def complete(self, prefix: str, limit: int) -> DataFrame:
        return c.complete(self.words, prefix, limit)

    def add_word(self, word: str, score: int) -> None:
        """Adds a word; one that is there already keeps its score."""
        self._added.setdefault(word, score)
        if len(self._added) >= HELD:
            self._loaded, self._added = cut(self.words), {}

    def stats(self) -> DataFrame:
        loaded = self._loaded.select(F.col("chunk_id").alias("id")).filter("id is not null").distinct()
        return d.completer_stats(self.words, loaded if self.available is None else self.available)

    def _load(self, found: DataFrame) -> None:
        found = found.select("word", score_of_rank(F.col("rank")).cast("long").alias("score"), F.col("chunk_id").cast("long").alias("chunk_id"))
        self._loaded = self._merged(self._loaded.select("word", "score", "chunk_id").unionByName(found))

    def load_chunk(self, path: str) -> None:
        """Loads one chunk file; no other file of its folder is opened."""
        folder, name = path.rsplit("/", 1)
        self._load(chunk_source.read(self.spark, folder).filter(F.col("chunk_id") == int(name.removeprefix("dict_").removesuffix(".bin"))))

    def load_all(self, folder: str) -> None:
        """Loads all chunk files of a folder; from then on these are the chunks there are."""
        self._load(chunk_source.read(self.spark, folder))
        self.available = chunk_source.headers(self.spark, folder).select("id")
