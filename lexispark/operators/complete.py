"""Prefix completion: one request, or a table of requests in one join with posting lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import BROWSER_MAX_LIMIT, browser_limit, capitalize, simple_lower, threshold

DEPTH = 3
#: Words that any clamped request reads of a bucket that equals its prefix: 1.5 or 2 times the largest limit.
CAP = 2 * BROWSER_MAX_LIMIT


def _first(limit: Column | int, factor: str):
    return limit * 2 if factor == "callback" else limit + (F.floor(limit / 2) if isinstance(limit, Column) else limit // 2)


def lowered(prefix: str) -> str:
    """A prefix in lower case, character by character, as exprs.simple_lower has it."""
    return prefix.translate({0x130: "i", 0x3A3: "σ"}).lower()


def complete(dictionary: DataFrame, prefix: str, limit: int, mode: str = "reference") -> DataFrame:
    """word, score, r (1..n): words that start with the lower-cased prefix, best scores first, ties by word.

    mode "reference" sorts the first 1.5 * limit words in word order, "callback" the first 2 * limit, "exact" all words. The filters
    on word and rank reach the scan; both limits are top-k operators.
    """
    low = lowered(prefix)
    short = len(low.encode()) <= 2 or (len(low.encode()) > 2 and len(set(low.encode())) == 1)
    found = dictionary.filter(F.col("word").startswith(low) & (F.col("word") != low) & (F.col("score") >= (24 if short else 20)))
    if mode != "exact":
        found = found.orderBy("word").limit(max(0, _first(limit, mode)))
    found = found.orderBy(F.desc("score"), "word").limit(max(0, limit))
    r = F.row_number().over(W.orderBy(F.desc("score"), "word")).cast("long")
    return found.select(capitalize(F.col("word"), F.lit(prefix)).alias("w"), F.col("score").cast("long").alias("score"), r.alias("r"))


def complete_each(dictionary: DataFrame, prefix: str, limit: int, deliver: Callable[[str, int], bool]) -> int:
    """Delivers the completions one by one until deliver returns False; returns how many were delivered."""
    n = 0
    for row in complete(dictionary, prefix, limit, "callback").orderBy("r").toLocalIterator():
        n += 1
        if not deliver(row["w"], row["score"]):
            break
    return n


def search(dictionary: DataFrame, prefix: str, limit: int, least: int) -> Iterator[tuple[str, int]]:
    """Unsorted search: the first `limit` words in word order."""
    found = dictionary.filter(F.col("word").startswith(prefix) & (F.col("word") != prefix) & (F.col("score") >= least))
    return ((r["word"], r["score"]) for r in found.orderBy("word").limit(max(0, limit)).toLocalIterator())


def postings(dictionary: DataFrame, depth: int = DEPTH, cap: int | None = CAP) -> DataFrame:
    """bucket, words, cap: for every leading string of 1..depth characters the words that start with it, in word order.

    A bucket shorter than depth is only asked by the prefix that equals it, so its list holds what such requests can read: filtered
    by the bucket's own threshold and, unless cap is None (modes that rank all words), the first `cap` words.
    """
    words = dictionary.select("word", F.col("score").cast("long").alias("score")).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.char_length("word")))))
    words = words.withColumn("bucket", F.substring(F.col("word"), F.lit(1), F.col("k"))).filter((F.col("k") == depth) | ((F.col("score") >= threshold(F.col("bucket"))) & (F.col("word") != F.col("bucket"))))
    entry = F.struct("word", "score")
    if cap is not None:
        long = words.filter(F.col("k") == depth).select("bucket", entry.alias("e"))
        r = F.row_number().over(W.partitionBy("bucket").orderBy("word"))
        short = words.filter(F.col("k") < depth).withColumn("r", r).filter(F.col("r") <= cap).select("bucket", entry.alias("e"))
        words = long.unionByName(short)
    else:
        words = words.select("bucket", entry.alias("e"))
    return words.groupBy("bucket").agg(F.sort_array(F.collect_list("e")).alias("words")).withColumn("cap", F.lit(cap).cast("int"))


def complete_batch(requests: DataFrame, lists: DataFrame, mode: str = "reference", depth: int = DEPTH) -> DataFrame:
    """Columns of requests (id, p, l) with s: array of (w, r, score). Works on streams; requests without a match keep an empty list.

    The join is on the bucket alone and above it nothing is shuffled. A request that would read beyond a list's cap fails; ask lists
    without a cap for such limits, and for mode "exact".
    """
    low = simple_lower(F.col("p"))
    asked = requests.withColumn("__low", low).withColumn("__bucket", F.substring(low, 1, depth))
    hit = asked.join(lists.withColumnRenamed("bucket", "__b"), F.col("__bucket") == F.col("__b"), "left")
    least = threshold(F.col("__low"))
    ok = F.filter(F.coalesce("words", F.array().cast(lists.schema["words"].dataType)), lambda x: x["word"].startswith(F.col("__low")) & (x["word"] != F.col("__low")) & (x["score"] >= least))
    limit = F.greatest(F.lit(0), F.col("l")).cast("int")
    cut = (F.char_length("__bucket") < depth) & (F.size("words") >= F.col("cap"))
    beyond = cut if mode == "exact" else cut & (_first(limit, mode) > F.col("cap"))
    ok = F.when(beyond, F.raise_error(F.lit("the posting lists are too short for this limit or mode"))).otherwise(ok)
    if mode != "exact":
        ok = F.slice(ok, F.lit(1), _first(limit, mode).cast("int"))
    keyed = F.array_sort(F.transform(ok, lambda x: F.struct((-x["score"]).alias("n"), x["word"].alias("word"))))
    best = F.slice(keyed, F.lit(1), limit)
    s = F.transform(best, lambda x, i: F.struct(capitalize(x["word"], F.col("p")).alias("w"), (i + 1).cast("long").alias("r"), (-x["n"]).alias("score")))
    return hit.select(*requests.columns, s.alias("s"))


def flat(answers: DataFrame) -> DataFrame:
    """id, w, r, score: a row per suggestion."""
    return answers.select("id", F.explode("s").alias("x")).select("id", "x.w", "x.r", "x.score")


def complete_browser(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """id, s (array of w, r), c: the browser entry's answers, with its own limits and without validation."""
    done = complete_batch(requests.withColumn("l", browser_limit(F.coalesce(F.col("l"), F.lit(0))).cast("long")), lists)
    return done.select("id", F.transform("s", lambda x: F.struct(x["w"].alias("w"), x["r"].alias("r"))).alias("s"), F.size("s").cast("long").alias("c"))


def complete_raw(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """id, s (array of word, frequency, rank), c: as the browser's raw entry, whose limits are not clamped; give it lists without a cap."""
    done = complete_batch(requests, lists)
    s = F.transform("s", lambda x: F.struct(x["w"].alias("word"), x["score"].alias("frequency"), x["r"].alias("rank")))
    return done.select("id", s.alias("s"), F.size("s").cast("long").alias("c"))
