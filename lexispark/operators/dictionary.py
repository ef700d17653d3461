"""Building and managing ranked, chunked dictionaries: table dict(word, frequency, pos, rank, score, chunk_id)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import MAX_RANK, score_of_rank, size_label
from ..sources.shared import cut

CHUNK_SIZE, MAX_WORDS = 10_000, 50_000


def word_frequencies(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, frequency: lower-cased runs of letters and digits of a text column."""
    words = texts.select(F.explode(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("frequency"))


def ranked(frequencies: DataFrame, chunk_size: int = CHUNK_SIZE, max_chunks: int = 0) -> DataFrame:
    """Adds pos (by frequency, then word), rank, score and chunk_id.

    A prefix sum over sampled ranges: words are dealt to ranges of (frequency, word) and sorted there, whatever words share a frequency; a
    word's position is its place in its range and the words of the ranges before it, of which only one count each is read. The ranges are
    checkpointed, so that counts and positions are of the same ranges and what calls this for several tables computes words once.
    """
    order = [F.desc("frequency"), F.col("word")]
    rows = frequencies.select("word", "frequency").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()))
    range_, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["r"]: r["n"] for r in rows.groupBy(range_.alias("r")).agg(F.count("*").alias("n")).collect()}  # one row a range
    before = [0, *accumulate(counts.get(r, 0) for r in range(max(counts, default=-1)))]
    return positioned(rows.withColumn("pos", F.element_at(F.lit(before), range_ + 1) + place + 1), chunk_size, max_chunks)


def positioned(words: DataFrame, chunk_size: int = CHUNK_SIZE, max_chunks: int = 0) -> DataFrame:
    """Rank, score and chunk of words that have a position."""
    if chunk_size <= 0 or max_chunks < 0:
        raise ValueError("chunk_size must be above 0 and max_chunks not below it")
    rank = F.least(F.col("pos"), F.lit(MAX_RANK))
    out = words.select("word", "frequency", F.col("pos").cast("long").alias("pos"), rank.cast("long").alias("rank"), score_of_rank(rank).cast("long").alias("score"), F.ceil(F.col("pos") / chunk_size).cast("long").alias("chunk_id"))
    return out.filter(F.col("chunk_id") <= max_chunks) if max_chunks else out


def merge_ranks(entries: DataFrame, mode: str = "least") -> DataFrame:
    """One row per word and chunk: the best rank, or ("sum") the 16-bit sum that the builder's insertion makes of repeats."""
    agg = F.min("rank") if mode == "least" else F.pmod(F.sum("rank"), F.lit(65_536))
    return entries.groupBy("chunk_id", "word").agg(agg.cast("long").alias("rank"))


def chunk_info(dictionary: DataFrame) -> DataFrame:
    """id, filename, word_count of each chunk."""
    return dictionary.groupBy(F.col("chunk_id").alias("id")).agg(F.count_distinct("word").alias("word_count")).select("id", F.format_string("dict_%04d.bin", "id").alias("filename"), "word_count")


def chunks_needed(max_words: int = MAX_WORDS, chunk_size: int = CHUNK_SIZE) -> int:
    return -(-max_words // chunk_size) if max_words > 0 and chunk_size > 0 else 1


def enough_chunks(chunks: DataFrame, needed: int) -> bool:
    return chunks.count() >= needed


def size_options(chunks: DataFrame) -> DataFrame:
    """chunk_count, word_count, size_label for each number of chunks. One row per chunk, so one window will do."""
    w = W.orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    words = F.sum("word_count").over(w)
    return chunks.select(F.count("*").over(w).alias("chunk_count"), words.cast("long").alias("word_count"), size_label(words).alias("size_label"))


def chunks_for_budget(chunks: DataFrame, max_words: int) -> DataFrame:
    """Ids of whole chunks, in id order, while the words before them are below the budget; 0 takes all, a negative budget none."""
    before = F.coalesce(F.sum("word_count").over(W.orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("b", before).filter(F.lit(max_words == 0) | (F.col("b") < max_words)).select("id")


def request_more(chunks: DataFrame, loaded: DataFrame, words: int, mode: str = "budget") -> DataFrame:
    """Ids to load for `words` more words; mode "all" takes every chunk that isn't loaded."""
    rest = chunks.join(loaded, "id", "left_anti")
    return rest.select("id") if mode == "all" else chunks_for_budget(rest, words) if words > 0 else rest.select("id").limit(0)


def resize(chunks: DataFrame, target: int, loaded: int | None = None, mode: str = "exact") -> DataFrame:
    """Ids of the active chunks for a target number; mode "reference" loads only as many as an earlier prefix leaves to count."""
    if target < 1:
        raise ValueError("target must be at least 1")
    n = target if mode == "exact" or loaded is None or target <= loaded else max(loaded, target - loaded)
    return chunks.select("id", F.row_number().over(W.orderBy("id")).alias("r")).filter(F.col("r") <= n).select("id")


def active(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    return dictionary.join(ids.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")


def loaded_ids(dictionary: DataFrame) -> DataFrame:
    """id: the chunks that the active dictionary holds, in order."""
    return dictionary.select(F.col("chunk_id").alias("id")).distinct().orderBy("id")


def evict(dictionary: DataFrame, *chunk_ids: int, strict: bool = False) -> DataFrame:
    """The dictionary without these chunks; strict: a chunk that isn't loaded is an error."""
    if strict:
        held = {r["id"] for r in dictionary.filter(F.col("chunk_id").isin(*chunk_ids)).select(F.col("chunk_id").alias("id")).distinct().collect()}
        if missing := sorted(set(chunk_ids) - held):
            raise ValueError(f"chunk {missing[0]} is not loaded")
    return dictionary.filter(~F.col("chunk_id").isin(*chunk_ids)) if chunk_ids else dictionary


def add_words(dictionary: DataFrame, more: DataFrame, winner: str = "first") -> DataFrame:
    """word, score after additions (more: word, score, seq); of repeats the first or the last counts, the dictionary being first."""
    rows = dictionary.select("word", "score", F.lit(-1).cast("long").alias("seq")).unionByName(more.select("word", "score", F.col("seq").cast("long").alias("seq")))
    pick = F.min_by if winner == "first" else F.max_by
    return rows.groupBy("word").agg(pick("score", "seq").alias("score"))


def one_per_word(dictionary: DataFrame) -> DataFrame:
    """Of a word in several chunks, the entry of the lowest chunk."""
    return dictionary.groupBy("word").agg(F.min_by(F.struct("rank", "score"), F.struct("chunk_id", "rank")).alias("e"), F.min("chunk_id").alias("chunk_id")).select("word", "e.rank", "e.score", "chunk_id")


def stats(dictionary: DataFrame, chunks: DataFrame) -> DataFrame:
    """total_words, loaded_chunks, available_chunks, max_frequency of the active dictionary."""
    own = dictionary.agg(F.count("*").alias("total_words"), F.count_distinct("chunk_id").alias("loaded_chunks"), F.coalesce(F.max("score"), F.lit(0)).cast("long").alias("max_frequency"))
    return own.crossJoin(chunks.agg(F.count("*").alias("available_chunks")))  # one row each


def completer_stats(dictionary: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, value: the completer's statistics as a table of names."""
    one = stats(dictionary, chunks)
    named = (("totalWords", "total_words"), ("maxFrequency", "max_frequency"), ("loadedChunks", "loaded_chunks"), ("availableChunks", "available_chunks"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("value")) for n, c in named], F.struct(F.lit("chunkLoader").alias("name"), F.lit(1).cast("long").alias("value")))).alias("x")).select("x.*")


def word_scores(dictionary: DataFrame) -> dict[str, int]:
    """The map of a dictionary that fits the driver."""
    return {r["word"]: r["score"] for r in dictionary.select("word", "score").toLocalIterator()}
