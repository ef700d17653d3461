"""Lines that recur across documents, by a log-template tree of fixed depth.

A line is parsed by its number of tokens and its leading tokens to a leaf of the tree. Tokens with a digit are variable at once. Within
a leaf the line's tokens form up to `FIELDS` fields; a field whose value fewer than `least_docs` documents have at that place is
variable, and what stays is the template. The leading tokens are the leaf's own and count for nothing here: only the fields after them
are looked at, and a line without any is its own template (this support counts rows; the documents of a template are counted exactly). A template that keeps at least `constant` of these fields and occurs in at least `least_docs`
documents is dropped, except in the document with the smallest doc_id that has it, so that groups of copies keep one original.

The tree is a set of aggregates: lines are counted once per document, equal lines are merged before the leaves are, and only leaves
with several different lines are looked into. Joins by leaf, line and template spread the few keys that many lines have (see
`common.join_spread`), so no task gets all lines of a leaf.

Lines of fewer than `SHORT` tokens are templates as they stand, without variable tokens or fields; lines of fewer than `least_tokens`
(by default none but blank ones) stay. Null and empty texts have no lines to drop and stay as they are. Rows that agree in
doc_id and text are one document. A document that loses all its lines stays with an empty text. Texts with any number of lines are
handled whole; the table may have any other columns, which stay as they are, and an empty table has no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, join_spread, key_of, map_arrow, packed, unpacked

LEAST_DOCS, LEAST_TOKENS, SHORT, DEPTH, FIELDS, CONSTANT = 3, 1, 5, 3, 16, 0.6
_DIGIT = re.compile(rb"[0-9]")
_MASK = b"<*>"


def parse(line: bytes, least_tokens: int = LEAST_TOKENS, depth: int = DEPTH, fields: int = FIELDS) -> tuple[int, int, list[int]] | None:
    """Leaf, line and hashes of the fields after the leading tokens; None for a line of too few tokens."""
    import xxhash

    tokens = line.split()
    n = len(tokens)
    if n < max(1, least_tokens):
        return None
    if n >= SHORT and _DIGIT.search(line):
        tokens = [_MASK if _DIGIT.search(t) else t for t in tokens]
    signed = lambda x, bits: x - (1 << bits) if x >> (bits - 1) else x
    leaf = signed(xxhash.xxh64_intdigest(b" ".join(tokens[:depth]), n), 64)
    whole = signed(xxhash.xxh64_intdigest(b" ".join(tokens), 1), 64)
    if n < SHORT:
        return leaf, whole, []
    k = min(fields, n)
    cuts = [n * i // k for i in range(k + 1)]
    # A field that holds only leading tokens is the same in the whole leaf.
    return leaf, whole, [signed(xxhash.xxh32_intdigest(b" ".join(tokens[a:b])), 32) for a, b in zip(cuts, cuts[1:], strict=False) if b > depth]


def lines(docs: DataFrame, least_tokens: int = LEAST_TOKENS, depth: int = DEPTH, fields: int = FIELDS) -> DataFrame:
    """key, doc_id, leaf, line, fields, at (numbers of the lines) for each different line of each document."""
    names = ["key", "doc_id", "leaf", "line", "fields", "at"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        for b in batches:
            out = [[] for _ in names]
            for key, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                seen: dict[int, list[int]] = {}
                for i, line in enumerate(text.encode().split(b"\n")):
                    got = parse(line, least_tokens, depth, fields)
                    if got is None:
                        continue
                    leaf, whole, values = got
                    if whole in seen:
                        seen[whole].append(i)
                    else:
                        seen[whole] = at = [i]
                        for c, v in zip(out, (key, doc_id, leaf, whole, values, at), strict=True):
                            c.append(v)
            yield batch(names, types, out)

    rows = docs.filter("text is not null").select(key_of().alias("key"), "doc_id", "text")
    return map_arrow(rows, run, "key long, doc_id long, leaf long, line long, fields array<int>, at array<int>")


def recurring(docs: DataFrame, least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS, depth: int = DEPTH, fields: int = FIELDS, constant: float = CONSTANT) -> DataFrame:
    """key, doc_id, at: the line numbers to drop, one row for each document that loses a line."""
    found = cut(lines(docs, least_tokens, depth, fields))
    each = cut(found.groupBy("leaf", "line").agg(F.count("*").alias("n_docs")))
    # Leaves with several lines that together occur often enough, and the support of each field value in them. Only their fields move.
    rich = each.groupBy("leaf").agg(F.sum("n_docs").alias("n"), F.count("*").alias("n_lines")).filter((F.col("n") >= least_docs) & (F.col("n_lines") > 1)).select("leaf", "n")
    inside = join_spread(found.select("leaf", "line", "fields"), cut(rich), ["leaf"], "n", "left_semi")
    inside = cut(inside.groupBy("leaf", "line").agg(F.count("*").alias("n_docs"), F.first("fields").alias("fields")))
    spread = inside.select("leaf", "line", "n_docs", F.size("fields").alias("k"), F.posexplode("fields").alias("place", "value"))
    support = spread.groupBy("leaf", "place", "value").agg(F.sum("n_docs").alias("s"), F.count("*").alias("n")).filter(F.col("s") >= least_docs).drop("s")
    kept = join_spread(spread, cut(support), ["leaf", "place", "value"], "n")
    kept = kept.groupBy("leaf", "line").agg(F.count("*").alias("n_kept"), F.max("k").alias("k"), F.sum(F.xxhash64("place", "value").cast("decimal(38,0)")).alias("shape"))
    templates = kept.filter(F.col("n_kept") >= constant * F.col("k")).select("leaf", "line", F.xxhash64(F.lit(1), "leaf", "shape").alias("template"))
    # Other lines are their own templates; those of one document are left out at once.
    named = each.join(templates, ["leaf", "line"], "left").filter((F.col("n_docs") >= least_docs) | F.col("template").isNotNull())
    named = named.select("leaf", "line", F.coalesce("template", F.xxhash64(F.lit(2), "leaf", "line")).alias("template"), "n_docs")
    at = cut(join_spread(found.drop("fields"), cut(named), ["leaf", "line"], "n_docs").select("template", "key", "doc_id", "at"))
    per_doc = at.groupBy("template", "key", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("first")
    often = per_doc.groupBy("template").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), first).filter(F.col("n_docs") >= least_docs)
    often = cut(often.select("template", "n", F.col("first.key").alias("keeper"), F.col("first.doc_id").alias("keeper_id")))
    drop = join_spread(at, often, ["template"], "n").filter(~((F.col("key") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("keeper_id"))))
    return drop.groupBy("key", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


def apply(docs: DataFrame, extra: bool = False, **how) -> DataFrame:
    """docs with the recurring lines taken out of the text (and n_chars, if there, made new). extra: with n_lines and n_dropped."""
    drop = recurring(docs, **how)
    rows = packed(docs).alias("r").join(drop.alias("d"), (F.col("r.key") == F.col("d.key")) & F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")), "left").select("r.row", "d.at")
    text = F.col("row").getField("text")
    all_lines = F.split(text, "\n", -1)
    # A flag for each line, made by one set difference and one sort, so a text's cost does not grow with lines times dropped lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "at")
    flag = lambda numbers, value: F.transform(numbers, lambda i: F.struct(i.alias("i"), F.lit(value).alias("stays")))
    flags = F.array_sort(F.concat(flag(stay, True), flag(F.col("at"), False)))
    left = F.array_join(F.zip_with(all_lines, flags, lambda x, f: F.when(f["stays"], x)), "\n")
    rows = rows.withColumn("left", F.when(F.col("at").isNull(), text).otherwise(left))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("at").isNull(), F.col("row").getField("n_chars")).otherwise(F.char_length("left"))
    if not extra:
        return unpacked(rows, docs, **new)
    rows = rows.withColumn("n_lines", F.greatest(F.coalesce(F.size(all_lines), F.lit(0)), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_dropped", F.greatest(F.coalesce(F.size("at"), F.lit(0)), F.lit(0)).cast("long"))
    columns = unpacked(rows, docs, **new).columns
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in columns], "n_lines", "n_dropped")
