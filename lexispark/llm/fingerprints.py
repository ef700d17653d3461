"""SimHash fingerprints from DataFrame functions alone, and permuted block tables for searches within a Hamming radius.

Terms are pairs of neighbouring words (lower case, split at white space; the last word stands alone too). A term's weight is 1 to 4 by
its length, so pairs of short, common words weigh least. The bits of a term's 64-bit hash vote with its weight, signed; a
fingerprint's bit is set where the sum is positive. Votes are summed sixteen to a group of four 16-bit lanes in a long, so a
document costs 16 sums, pre-aggregated before the shuffle; blocks of positions keep the lanes from overflowing, so no text is too
long. A text is voted on where it is read; for the edited texts the heads travel to the texts that they are put after, in sorted joins,
which spill, and no table of texts is held in memory.

The search: if two fingerprints differ in at most r of 64 bits in b blocks, they agree in b - r blocks at least; each choice of so many
blocks is a table whose key is these blocks' bits put first. Candidates share a key in some table and are verified.

Null texts count as empty. Rows that agree in doc_id and text are one document in the order of documents, and each gets the result.
The order is descending doc_id, nulls last, then descending row key. Texts of any length are handled whole; columns besides doc_id and
text are not looked at. An empty table has no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, key_of

#: Positions of a block. A lane takes 4 from each at most; the highest one must stay below 2^15, or the sum leaves the range of a long.
POSITIONS = 8_000
RADIUS, BLOCKS = 3, 5
_LANES = 0x0001000100010001


def vote(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp (signed long) of each row of texts; keys tell rows apart, rows of equal keys have equal texts."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")
    rows = texts.select(*keys, words.alias("__w"))
    # Each word, and the next one taken from the same array: no array of pairs is made.
    terms = rows.select(*keys, "__w", F.posexplode("__w").alias("pos", "x"))
    terms = terms.select(*keys, F.floor(F.col("pos") / POSITIONS).cast("int").alias("__blk"), "x", F.get("__w", F.col("pos") + 1).alias("y"))
    length = F.length("x") + F.coalesce(F.length("y"), F.lit(0))
    terms = terms.select(*keys, "__blk", F.xxhash64("x", "y").alias("h"), (F.least(F.lit(3), F.floor(length / 8)) + 1).cast("long").alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{j}") for j in range(16)]
    sums = terms.groupBy(*keys, "__blk").agg(*lanes, F.sum("w").alias("w"))
    ones = [F.sum(F.shiftrightunsigned(f"v{b % 16}", 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"b{b}") for b in range(64)]
    bits = sums.groupBy(*keys).agg(*ones, F.sum("w").alias("w"))
    fp = None
    for b in range(64):
        bit = F.shiftleft((2 * F.col(f"b{b}") > F.col("w")).cast("long"), b)
        fp = bit if fp is None else fp.bitwiseOR(bit)
    return bits.select(*keys, fp.alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def following(ids: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """doc_id, key, n_chars, next_id, next_key: the next row in descending order of (doc_id, key), after the last the first.

    ids: doc_id, key, n_chars, distinct. They are dealt out in ranges of the order, as many as there are rows for, so a doc_id that
    many rows have spreads too; each range's first row then meets those of the others in one window of one row a range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    parts = max(1, -(-ids.count() // per_bucket))
    rows = cut(ids.repartitionByRange(parts, *order).withColumn("b", F.spark_partition_id()))
    mine = W.partitionBy("b").orderBy(*order)
    this = F.struct("doc_id", "key")
    rows = rows.withColumn("n", F.lead(this).over(mine))
    firsts = rows.groupBy("b").agg(F.max_by(this, F.struct(F.col("doc_id").isNotNull(), "doc_id", "key")).alias("k"))
    after = firsts.select("b", F.lead("k").over(W.orderBy("b")).alias("f"), F.first("k").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)).alias("top"))
    rows = rows.join(after, "b").withColumn("n", F.coalesce("n", "f", "top"))
    return rows.select("doc_id", "key", "n_chars", F.col("n.doc_id").alias("next_id"), F.col("n.key").alias("next_key"))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_chars, edited_sha256, fp, edited_fp, next_fp of every row.

    The edited text has the last third of its code points replaced by as many first ones of the next document's text.
    """
    keyed = docs.select("doc_id", key_of().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = cut(keyed.select("doc_id", "key", F.char_length("text").cast("long").alias("n_chars")))
    ids = rows.distinct()
    order = cut(following(ids))
    # Rows that repeat are one document. Where there are none, no text has to be sorted to find that out.
    texts = keyed if rows.count() == order.count() else keyed.dropDuplicates(["doc_id", "key"])
    need = order.select("next_id", "next_key", F.col("doc_id").alias("for_id"), F.col("key").alias("for_key"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    heads = texts.join(need, (F.col("key") == F.col("next_key")) & F.col("doc_id").eqNullSafe(F.col("next_id")))
    heads = heads.select("for_id", "for_key", "need", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"))
    left = F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.col("need"))
    edited = texts.join(heads, (F.col("key") == F.col("for_key")) & F.col("doc_id").eqNullSafe(F.col("for_id"))).select("doc_id", "key", F.concat(left, "head").alias("text"))
    # The digest rides along as a key, so that the edited texts are made once.
    changed = vote(edited.withColumn("sha", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))), ["doc_id", "key", "sha"]).withColumnRenamed("fp", "edited_fp")
    fps = cut(vote(texts, ["doc_id", "key"]))
    same = lambda a, b, k, i: (F.col(f"{a}.{k}") == F.col(f"{b}.key")) & F.col(f"{a}.{i}").eqNullSafe(F.col(f"{b}.doc_id"))
    each = order.alias("o").join(fps.alias("f"), same("o", "f", "key", "doc_id")).select("o.doc_id", "o.key", "o.next_id", "o.next_key", "f.fp")
    each = each.alias("e").join(fps.alias("n"), same("e", "n", "next_key", "next_id")).select("e.doc_id", "e.key", "e.fp", F.col("n.fp").alias("next_fp"))
    each = each.alias("e").join(changed.alias("c"), same("e", "c", "key", "doc_id")).select("e.*", F.lower(F.hex("c.sha")).alias("edited_sha256"), "c.edited_fp")
    return rows.alias("r").join(cut(each).alias("e"), same("r", "e", "key", "doc_id")).select("r.*", "e.edited_sha256", "e.fp", "e.edited_fp", "e.next_fp")


def block_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One key for each permuted table."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        m = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
        out.append(F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("bits")))
    return F.array(*out)


def within(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query, fp, distance: the distinct fingerprints of fps (column fp) within the radius of each distinct one of queries (column fp)."""
    tabled = lambda df, name: df.select("fp").distinct().select(F.col("fp").alias(name), F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k")).select(name, "k.t", "k.bits")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).cast("int")
    return tabled(fps, "fp").join(tabled(queries, "query"), ["t", "bits"]).filter(distance <= radius).select("query", "fp", distance.alias("distance")).distinct()
