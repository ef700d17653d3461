"""Text word lists: word TAB digits, sorted by frequency. Two parsers, for the builder and for the browser entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_builder(lines: DataFrame) -> DataFrame:
    """Adds word and frequency; lines without a tab before digits are left out. The first tab that digits follow parts the two."""
    p = r"^(.*?)\t([0-9]+)"
    return lines.filter(F.col("value").rlike(p)).select("*", F.regexp_extract("value", p, 1).alias("word"), F.regexp_extract("value", p, 2).cast("long").alias("frequency"))


def parse_browser(lines: DataFrame) -> DataFrame:
    """Adds word and frequency: parted at the first tab, which may not be first or last; the leading digits count, none give 0."""
    at = F.instr("value", "\t")
    rows = lines.filter((F.col("value") != "") & (at > 1) & (at < F.char_length("value")))
    word, rest = F.substring(F.col("value"), F.lit(1), at - 1), F.substring(F.col("value"), at + 1, F.char_length("value"))
    return rows.select("*", word.alias("word"), F.coalesce(F.regexp_extract(rest, r"^([0-9]*)", 1).try_cast("long"), F.lit(0)).alias("frequency"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """word, frequency, pos of a list's file; pos is the place among the lines that count.

    The file is read in splits. Lines are in order by split and, in a split, as they come; the lines of each split are counted and only
    these counts are accumulated, so no window holds more than a split. Several files follow each other by name.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = parse_builder(lines.withColumn("line", F.monotonically_increasing_id()))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    own = F.row_number().over(W.partitionBy("file", "start").orderBy("line"))
    return rows.join(splits, ["file", "start"]).select("word", "frequency", (F.col("before") + own).alias("pos"))


def bulk(lines: DataFrame, order: str) -> DataFrame:
    """word, score of a list that comes as a whole (value, and a column that orders the lines): of a word's repeats the first counts."""
    return parse_browser(lines).groupBy("word").agg(F.min_by("frequency", order).alias("score"))


def bulk_count(lines: DataFrame) -> DataFrame:
    """words: the number that such a load reports, repeats included."""
    return parse_browser(lines).agg(F.count("*").alias("words"))
