"""Token counts from pre-token frequencies.

Every different pre-token of the table is counted once, by the tokenizer, in a table of counts; every document's pre-tokens with their
frequencies are joined to that table and summed. No ids are kept. The join comes in two parts, so that no frequent pre-token makes a hot
key: the `HOT` pre-tokens that most documents have, found by a first pass over all texts, are a table of bounded size that goes to every
task; the others, each of which few documents have, are shuffled. Which pre-tokens are hot bears on the way alone, never on a count: a
pre-token that more than 1 in `TOP` / (pre-tokens of a text) documents have is among some task's `TOP` and so known to the first pass.

Special strings inside a text count as one token each, as the tokenizer has them by default. Null texts count as empty: no bytes, no
tokens. Rows that repeat are counted each; texts of any length are handled whole; columns besides doc_id and text are not looked at; an
empty table has no rows. A tokenizer file with another normaliser, pre-tokeniser or model kind than byte-level BPE counts whole texts.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow

#: Pre-tokens that go to every task, those that a task names of its own, the longest of either (code points), and those a task holds.
HOT, TOP, LONGEST, HELD = 200_000, 20_000, 48, 400_000
#: Stands between the pre-tokens of a document; those that hold it themselves are counted where they are found.
_BETWEEN = "\x00"


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def lengths(texts: list[str], path: str) -> list[int]:
    return [len(e.ids) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(2)
def _rules(path: str) -> tuple[bool, list[str]]:
    """Whether the file is plain byte-level BPE (pre-tokens by the public pattern), and its special strings."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre = said.get("pre_tokenizer") or {}
    plain = not said.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    model = said["model"]
    plain = plain and model.get("type", "BPE") == "BPE" and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
    added = said["added_tokens"]
    return plain and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")), [t["content"] for t in added]


@lru_cache(2)
def _splitter(path: str) -> Callable[[str], tuple[list[str], int]]:
    """Pre-tokens of a text, and its number of special strings."""
    import public_tokenizers
    import regex

    found, special = regex.compile(public_tokenizers.PATTERN).findall, _rules(path)[1]
    marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def split(text: str) -> tuple[list[str], int]:
        if not any(s in text for s in special):
            return found(text), 0
        parts = marks.split(text)
        return [p for x in parts for p in found(x)], len(parts) - 1

    return split


def hot_counts(rows: DataFrame, path: str, hot: int = HOT, top: int = TOP, held: int = HELD) -> dict[str, int]:
    """Counts of the pre-tokens that most documents have, at most `hot`. rows: text."""

    def tops(batches):
        split, seen = _splitter(path), Counter()

        def most():
            found = seen.most_common(top)
            return batch(["piece", "n"], [pa.string(), pa.int64()], [[p for p, _ in found], [n for _, n in found]])

        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update({p for p in split(text)[0] if len(p) <= LONGEST and _BETWEEN not in p})
            if len(seen) > held:
                yield most()
                seen.clear()
        yield most()

    often = map_arrow(rows.select("text"), tops, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(hot)
    return {r["piece"]: r["n"] for r in _counted(often.select("piece"), path).collect()}


def _counted(pieces: DataFrame, path: str) -> DataFrame:
    """piece, n: the number of tokens of each piece."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(lengths(b.column("piece").to_pylist(), path), pa.int32())], names=["piece", "n"])

    return map_arrow(pieces, run, "piece string, n int")


def frequencies(rows: DataFrame, path: str, hot: dict[str, int]) -> DataFrame:
    """id, doc_id, n_bytes, known (tokens of the hot pre-tokens and special strings), pieces (the others), f (their frequencies)."""
    known = rows.sparkSession.sparkContext.broadcast(hot)
    names, types = ["id", "doc_id", "n_bytes", "known", "pieces", "f"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = _splitter(path), known.value.get
        for b in batches:
            sums, pieces, f = [], [], []
            for text in b.column("text").to_pylist():
                found, total = split(text)
                often = Counter(found)
                n = list(map(count, often))
                total += sum(x * y for x, y in zip(n, often.values(), strict=True) if x is not None)
                new = [x is None for x in n]
                rest, times = list(compress(often, new)), list(compress(often.values(), new))
                if any(_BETWEEN in p for p in rest):
                    odd = [_BETWEEN in p for p in rest]
                    total += sum(x * y for x, y in zip(lengths(list(compress(rest, odd)), path), compress(times, odd), strict=True))
                    even = [not x for x in odd]
                    rest, times = list(compress(rest, even)), list(compress(times, even))
                sums.append(total)
                pieces.append(_BETWEEN.join(rest) if rest else None)
                f.append(times)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc_id"), b.column("n_bytes"), *(pa.array(x, t) for x, t in zip((sums, pieces, f), types[3:], strict=True))], names=names)

    return map_arrow(rows, run, "id long, doc_id long, n_bytes long, known long, pieces string, f array<int>")


def count(docs: DataFrame, path: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    if not _rules(path)[0]:
        return _whole(rows, path)
    # The checkpoint fixes the numbers of the rows.
    of = cut(frequencies(rows, path, hot_counts(rows, path, hot)))
    pairs = of.filter("pieces is not null").select("id", F.explode(F.arrays_zip(F.split("pieces", _BETWEEN).alias("piece"), "f")).alias("x")).select("id", "x.piece", "x.f")
    # The filters always hold; by them and by what is asked of id and f this exchange is the same as the join's, so the pairs move once.
    pairs = pairs.filter("piece is not null and id is not null").repartition("piece")
    distinct = pairs.groupBy("piece").agg(F.max("id").alias("id"), F.max("f").alias("f")).filter("id >= 0 and f > 0").select("piece")
    sums = pairs.join(_counted(distinct, path).hint("merge"), "piece").groupBy("id").agg(F.sum(F.col("f").cast("long") * F.col("n")).alias("cold"))
    n_tokens = F.col("known") + F.coalesce("cold", F.lit(0))
    return of.drop("pieces", "f").join(sums, "id", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"))


def _whole(rows: DataFrame, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(lengths(b.column("text").to_pylist(), path), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return map_arrow(rows.select("doc_id", "n_bytes", "text"), run, "doc_id long, n_bytes long, n_tokens long")
