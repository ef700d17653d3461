"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix takes the point frac((i + 1) * golden ratio) through the cumulative target shares and so falls to a source; the
r-th slot of a source takes the r-th block from that source's documents, which lie end to end in a shuffled order, one pass after the
other, a pass with a shuffle of its own. A source's blocks are its target divided by its number of slots, rounded up, and end at the
target, so each source takes its target to the word; a source that no slot falls to gets one after the others. Slots and documents are ranked by bucket totals first, so no source is
handled by one task.

Sizes are numbers of words (null text: 0). Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating. Targets share
the sum of all sizes by weight; none is above `most` times its source's size, the excess is reshared until none is. Rows that repeat
are documents of their own with equal parts of the mix; an empty table or one without words takes nothing. Texts of any length are
handled whole. The table may have any other columns; rows that differ in one of them are different documents. A mix of more than
`MAX_SOURCES` sources is refused, as the sources' totals (not their documents) are held by the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, key_of, parts_for, range_of, running_total

WEIGHTS, MOST, BLOCK, BUCKET_ROWS = (1, 2, 3), 3, 8192, 4_000
GOLDEN = (math.sqrt(5) - 1) / 2
#: More sources than this are no mix of sources; their totals are held by the driver.
MAX_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key() -> Column:
    return F.xxhash64(key_of(), F.col("source").isNull(), F.col("source"))


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Target of each source: shares of the total by weight, held at `most` times the size, the excess reshared by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, rest, left = {}, float(sum(sizes.values())), set(order)
    while left:
        w = sum(weight[s] for s in left)
        full = {s for s in left if rest * weight[s] / w > most * sizes[s]}
        if not full:
            out |= {s: rest * weight[s] / w for s in left}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(most * sizes[s] for s in full)
        left -= full
    return out


def falls(spark, shares: list[float], n: int) -> DataFrame:
    """slot, source_no of n slots."""
    total, edges, sum_ = sum(shares), [], 0.0
    for s in shares[:-1]:
        sum_ += s
        edges.append(sum_ / total)
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    point = point - F.floor(point)
    # The number of edges at or below the point.
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point)
    if len(edges) <= 64:
        number = sum((F.when(F.col("point") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    else:
        number = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("point")))
    return slots.select("slot", number.cast("int").alias("source_no"))


def schedule(spark, shares: list[float], n: int) -> DataFrame:
    """slot, source_no, rank (of the slot among its source's) of n slots."""
    slots = falls(spark, shares, n).withColumn("__bucket", F.shiftright("slot", 14)).withColumn("__one", F.lit(1).cast("long"))
    return running_total(slots, ["source_no"], "__bucket", [F.col("slot")], "__one", "rank").select("slot", "source_no", "rank")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 0, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their part in the mix, and the schedule's blocks joined to parts of documents.

    First: key (by default see key_of), copy (among rows that repeat), doc_id, size, source_size, target, and taken. Second: slot,
    key, doc_id, copy, pass_no, at (place in the source's passes), begin, end (words of the document).
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", (row_key() if key is None else key).alias("key"), n_words(F.col("text")).alias("size"))
    # Rows that repeat are told apart by number; their parts of the mix may be exchanged among them.
    same = sized.groupBy("key", "doc_id", "source", "size").agg(F.count("*").cast("int").alias("copies"))
    rows = cut(same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["s"] for r in totals}
    target = targets(sizes, weights, most)
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    total = sum(sizes.values())
    n, shares = -(-total // block), [target[s] for s in order]
    of = {r["source_no"]: r["n"] for r in falls(spark, shares, n).groupBy("source_no").agg(F.count("*").alias("n")).collect()} if n else {}
    quota = [round(x) for x in shares]
    late = [i for i, q in enumerate(quota) if q and i not in of]
    schema = "source_no int, source string, source_size long, target double, quota long, block long"
    table = spark.createDataFrame([(i, s, sizes[s], target[s], quota[i], max(1, -(-quota[i] // of.get(i, 1)))) for i, s in enumerate(order)], schema)
    near = F.broadcast(table) if len(order) <= 1000 else table
    rows = rows.join(near.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    if not n:
        return rows.drop("quota", "block").withColumn("taken", F.lit(0).cast("long")), spark.createDataFrame([], "slot long, key long, doc_id long, copy int, pass_no int, at long, begin long, end long")
    slots = schedule(spark, shares, n)
    if late:
        more = spark.createDataFrame([(n + k, i, 0) for k, i in enumerate(late)], "slot long, source_no int, rank long")
        slots = slots.select("slot", "source_no", F.col("rank").cast("long").alias("rank")).unionByName(more)
    # A block of rank r holds words [r * block, (r + 1) * block) of the source's passes up to its quota; a pass is one more shuffle.
    passes = rows.filter("size > 0 and quota > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_size")).cast("int"))))
    shuffled = F.xxhash64("key", "doc_id", "copy", F.lit(seed), "pass_no")
    passes = passes.withColumn("__h", shuffled).withColumn("__bucket", range_of(F.col("__h"), parts_for(rows.count(), BUCKET_ROWS)))
    laid = running_total(passes, ["source_no", "pass_no"], "__bucket", [F.col("__h"), F.col("key"), F.col("doc_id"), F.col("copy")], "size", "__at")
    laid = laid.withColumn("__at", F.col("__at") + F.col("pass_no") * F.col("source_size"))
    laid = laid.filter("__at < quota").withColumn("__to", F.least(F.col("size"), F.col("quota") - F.col("__at")))
    first, last = F.expr("__at div block"), F.expr("(__at + __to - 1) div block")
    parts = laid.withColumn("rank", F.explode(F.sequence(first, last)))
    joined = parts.join(slots, ["source_no", "rank"])
    begin = F.greatest(F.lit(0), F.col("rank") * F.col("block") - F.col("__at"))
    end = F.least(F.col("__to"), (F.col("rank") + 1) * F.col("block") - F.col("__at"))
    blocks = joined.select("slot", "key", "doc_id", "copy", "pass_no", F.col("__at").alias("at"), begin.cast("long").alias("begin"), end.cast("long").alias("end"))
    taken = blocks.groupBy("key", "doc_id", "copy").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    same = (F.col("r.key") == F.col("t.key")) & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.copy") == F.col("t.copy"))
    out = rows.drop("quota", "block").alias("r").join(taken.alias("t"), same, "left").select("r.*", F.coalesce("t.taken", F.lit(0)).alias("taken"))
    return out, blocks


def whole_key(docs: DataFrame) -> Column:
    """Identity of a row by all its columns (together with doc_id): rows that agree in it may stand for each other."""
    hashed = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    return F.xxhash64(*[y for x in hashed for y in (x.isNull(), x)])


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix as rows with the columns of docs, in the order of the schedule's slots.

    There is a row for each pass that takes a document, at the first slot that it falls to; the one that a source's last block cuts is
    cut after its last taken word.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), whole_key(docs).alias("key"), n_words(F.col("text")).alias("size"))
    parts, blocks = mix(docs, weights, most, block, seed, whole_key(docs))
    spans = blocks.groupBy("key", "doc_id", "copy", "pass_no").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min(F.struct("slot", "at")).alias("place"))
    # Rows that repeat are equal, so one of them stands for all and each copy's spans join to it.
    one = packed.dropDuplicates(["key", "doc_id"]) if parts.filter("copy > 1").limit(1).count() else packed
    got = one.alias("o").join(spans.alias("s"), (F.col("o.key") == F.col("s.key")) & F.col("o.doc_id").eqNullSafe(F.col("s.doc_id"))).select("o.row", "o.size", "s.key", "s.copy", "s.begin", "s.end", "s.place")
    text = F.col("row").getField("text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.array_join(F.slice(words, (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")), "")
    taken = F.when((F.col("begin") == 0) & (F.col("end") == F.col("size")), text).otherwise(some)
    got = got.withColumn("taken", taken).orderBy("place.slot", "place.at", "key", "copy")
    new = {"text": F.col("taken"), "n_chars": F.char_length("taken")}
    return got.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
